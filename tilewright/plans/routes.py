"""The engine's entry points: one function per request of an annotation client, each over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.operators import drawing, evaluation, masks, matching, review, statistics, sweep, transactions
from tilewright.operators.dataset import ancestors
from tilewright.sources import coco, files

# ------------------------------------------------------------- reading


def load(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The dataset of a directory, or an empty one where it has none."""
    path = coco.find_dataset(spark, directory)
    return files.empty_dataset(spark) if path is None else coco.read_dataset(spark, path)


def image_annotations(data: dict[str, DataFrame], name: str) -> DataFrame:
    return review.of_image(data["annotations"], data["images"], name)


def fsmeta(listing: DataFrame, wanted: str | None = None) -> DataFrame:
    return files.directory_entries(listing, wanted)


def dir_counts(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return statistics.image_counts(images, annotations)


def dir_stats(annotations: DataFrame) -> DataFrame:
    return statistics.area_histogram(annotations)


def crop_rect(rects: DataFrame) -> DataFrame:
    """Requested rectangles (x0 … y1, width, height) as whole pixels inside their image; an empty one raises as it is read."""
    cut = rects
    for axis, whole in (("x", "width"), ("y", "height")):
        for k in (0, 1):
            cut = cut.withColumn(f"{axis}{k}", G.clamp(G.half_even(F.col(f"{axis}{k}")), F.lit(0), F.col(whole)).cast("long"))
    empty = (F.col("x0") >= F.col("x1")) | (F.col("y0") >= F.col("y1"))
    return cut.withColumn("x0", F.when(empty, F.raise_error(F.lit("empty rectangle")).cast("long")).otherwise(F.col("x0")))


def cache_stats(lookups: DataFrame, entries: DataFrame) -> DataFrame:
    return review.cache_figures(lookups, entries)


# ------------------------------------------------------------- detecting


def run_sweep(images: DataFrame, detect: sweep.Detector, **knobs) -> DataFrame:
    """Events of a sweep over images; unknown or impossible knobs raise before anything runs."""
    return sweep.sweep(images, detect, sweep.SweepParams.resolve(**knobs))["events"]


def reprompt_boxes(hulls: DataFrame, images: DataFrame, pool: DataFrame, detect: sweep.Detector, **knobs) -> DataFrame:
    return sweep.reprompt(hulls, images, pool, detect, sweep.SweepParams.resolve(**knobs))


def segment(detections: DataFrame, score: float = 0.5) -> DataFrame:
    """Detections that reach the score threshold."""
    return detections.where(F.col("score") >= score)


def dedup_instances(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    pairs = evaluation.pairs(boxes, boxes.drop("score")).where("pred_id <> ref_id")
    near = pairs.select(*evaluation.GROUP, F.col("pred_id").alias("a"), F.col("ref_id").alias("b"), "iou")
    groups = matching.seeded_groups(boxes, near, evaluation.GROUP, threshold)
    return review.group_response(groups, boxes, evaluation.GROUP)


# ------------------------------------------------------------- editing


def draw_mask(stored: DataFrame, ops: DataFrame, height: int, width: int, key: str = "ann_id") -> DataFrame:
    return drawing.draw_masks(stored, ops, key, height, width)


def update_annotation(stored: DataFrame, ops: DataFrame, height: int, width: int, key: str = "ann_id") -> DataFrame:
    return drawing.update_masks(stored, ops, key, height, width)


def mask_crop(rects: DataFrame, window: Sequence[int]) -> DataFrame:
    """Rectangles of masks inside a window, in its coordinates."""
    placed = rects.withColumns({f"w_{c}": F.lit(int(v)) for c, v in zip(("x0", "y0", "x1", "y1"), window, strict=True)})
    return masks.inside_window(placed).drop(*[f"w_{c}" for c in ("x0", "y0", "x1", "y1")])


save = transactions.save
delete_annotation = transactions.delete
edit_labels = transactions.edit_labels


def record_searches(index: DataFrame, records: DataFrame, listing: DataFrame, directory: str | None = None) -> DataFrame:
    """The search index with new records; written to its folder where one is given."""
    found = transactions.upsert_searches(index, records, transactions.fingerprint_status(index, listing))
    if directory is not None:
        transactions.write_searches(found.join(records.select("name").distinct(), "name", "left_semi"), directory)
    return found


def export(images: DataFrame, rects: DataFrame, labels: Sequence[str], force: bool = False) -> DataFrame:
    return masks.export_masks(images, rects, labels, force)


def label_tree(categories: DataFrame, own: DataFrame) -> DataFrame:
    return review.forest(categories, own).orderBy("path")


def label_path(categories: DataFrame) -> DataFrame:
    """(name, path): every label under its ancestors."""
    above = ancestors(categories).groupBy("name").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "ancestor"))).alias("up"))
    up = F.concat(F.coalesce(F.transform("up", lambda x: x["ancestor"]), F.array().cast("array<string>")), F.array("name"))
    return categories.join(above, "name", "left").select("name", F.array_join(up, "/").alias("path"))


# ------------------------------------------------------------- evaluating


def compare(pred: DataFrame, ref: DataFrame, images: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Instance report of predicted against reference masks (rectangles), per image and category, per category and overall."""
    return evaluation.report(evaluation.mask_outcomes(pred, ref, threshold), images)


def summary(pred: DataFrame, ref: DataFrame, images: DataFrame) -> DataFrame:
    return review.dashboard(evaluation.image_scores(evaluation.outcomes(pred, ref)), ref, pred, images)


def image_eval(pred: DataFrame, ref: DataFrame, image: int, kinds: Sequence[str] = ("tp", "fp", "fn")) -> DataFrame:
    """Outcome rows of one image, of the kinds that are shown."""
    one = F.col("image_id") == image
    return review.overlays(evaluation.listed(evaluation.outcomes(pred.where(one), ref.where(one))), kinds)
