"""Scoring of predicted against reference annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.operators.masks import mask_area, mask_pairs
from tilewright.operators.matching import greedy_match
from tilewright.operators.runs import box_strips, clip_boxes, strip_union_area
from tilewright.operators.spatial import range_join

GROUP = ["image_id", "category"]
#: Upper edges of the size bands; a value on an edge belongs to the next band.
BAND_EDGES = (8, 16, 32, 64, 128)


def pairs(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """Overlapping boxes of one image and category with areas, intersection and IoU."""
    found = range_join(pred.drop("score"), ref, GROUP)
    return found.select(*GROUP, F.col("a_ann_id").alias("pred_id"), F.col("b_ann_id").alias("ref_id"), G.area("a_").alias("pred_area"), G.area("b_").alias("ref_area"), G.overlap("a_", "b_").alias("inter"), G.iou("a_", "b_").alias("iou"))


def matches(pred: DataFrame, ref: DataFrame, threshold: float = 0.5) -> DataFrame:
    edges = pairs(pred, ref).select(*GROUP, F.col("pred_id").alias("pred"), F.col("ref_id").alias("ref"), "iou")
    return greedy_match(edges, GROUP, threshold)


def outcomes(pred: DataFrame, ref: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(image_id, category, kind, pred, ref, iou, area): tp pairs, then fp and fn rows."""
    sized = lambda side: side.select(*GROUP, "ann_id", G.area("").alias("area"))
    return outcomes_of(matches(pred, ref, threshold), sized(pred), sized(ref))


def mask_outcomes(pred: DataFrame, ref: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The same of masks, given as disjoint rectangles."""
    edges = mask_pairs(pred, ref).select(*GROUP, F.col("pred_id").alias("pred"), F.col("ref_id").alias("ref"), "iou")
    return outcomes_of(greedy_match(edges, GROUP, threshold), mask_area(pred, [*GROUP, "ann_id"]), mask_area(ref, [*GROUP, "ann_id"]))


def outcomes_of(found: DataFrame, pred: DataFrame, ref: DataFrame) -> DataFrame:
    """Outcomes of matched pairs among all instances (group, ann_id, area) of both sides."""
    p = pred.select(*GROUP, F.col("ann_id").alias("pred"), F.col("area").alias("pred_area"))
    r = ref.select(*GROUP, F.col("ann_id").alias("ref"), F.col("area").alias("ref_area"))
    both = r.join(found, [*GROUP, "ref"], "left")
    hit_or_missed = both.select(*GROUP, F.when(F.col("pred").isNull(), "fn").otherwise("tp").alias("kind"), "pred", "ref", "iou", F.col("ref_area").alias("area"))
    extra = p.join(found.select(*GROUP, "pred"), [*GROUP, "pred"], "left_anti")
    return hit_or_missed.unionByName(extra.select(*GROUP, F.lit("fp").alias("kind"), "pred", F.lit(None).cast("long").alias("ref"), F.lit(None).cast("double").alias("iou"), F.col("pred_area").alias("area")))


def listed(found: DataFrame) -> DataFrame:
    """Evaluation rows: category, kind, ids, area, and IoU with four places."""
    return found.select("image_id", "category", "kind", "pred", "ref", "area", G.places(F.col("iou"), 4).alias("iou"))


def metrics(tp: Column, fp: Column, fn: Column, iou_sum: Column) -> dict[str, Column]:
    """Ratios of the counts; 0/0 is 0."""
    return {
        "precision": G.ratio(tp, tp + fp),
        "recall": G.ratio(tp, tp + fn),
        "f1": G.ratio(2 * tp, 2 * tp + fp + fn),
        "sq": G.ratio(iou_sum, tp),
        "rq": G.ratio(2 * tp, 2 * tp + fp + fn),
        "pq": G.ratio(iou_sum, tp) * G.ratio(2 * tp, 2 * tp + fp + fn),
    }


def report(found: DataFrame, images: DataFrame) -> DataFrame:
    """Counts and ratios per (file, category), per category and overall, in one pass of grouping sets.

    IoU is summed in millionths, as integers, so that the sum has no order.
    """
    named = found.join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id")
    count = lambda k: F.sum((F.col("kind") == k).cast("long"))
    sums = named.groupingSets([["file_name", "category"], ["category"], []], "file_name", "category").agg(
        F.grouping_id().cast("long").alias("level"), count("tp").alias("tp"), count("fp").alias("fp"), count("fn").alias("fn"), F.coalesce(F.sum(F.rint(F.col("iou") * 1000000).cast("long")), F.lit(0)).alias("micro")
    )
    ratios = metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("micro") / F.lit(1e6))
    return sums.select("file_name", "category", "level", "tp", "fp", "fn", *[c.alias(k) for k, c in ratios.items()])


def band(area: Column, downscale: int = 1) -> Column:
    """Band number of an object by the side of its area, from 0; areas are compared squared, as integers."""
    out = F.lit(0)
    for edge in BAND_EDGES:
        out = out + (area >= (edge * downscale) ** 2).cast("int")
    return out


def band_recall(found: DataFrame, downscale: int = 1) -> DataFrame:
    """(category, band, label, total, hits, recall) with every band of every category; recall of an empty band is null."""
    refs = found.where(F.col("kind") != "fp").select("category", band(F.col("area"), downscale).alias("band"), (F.col("kind") == "tp").cast("long").alias("hit"))
    sums = refs.groupBy("category", "band").agg(F.count("*").alias("total"), F.sum("hit").alias("hits"))
    spine = found.select("category").distinct().withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(len(BAND_EDGES)))))
    edges = F.array(*[F.lit(x) for x in (0, *BAND_EDGES)])
    low = F.element_at(edges, F.col("band") + 1)
    label = F.when(F.col("band") == len(BAND_EDGES), F.concat(F.lit(">="), low.cast("string"))).otherwise(F.concat_ws("-", low, F.get(edges, F.col("band") + 1)))
    filled = spine.join(sums, ["category", "band"], "left").select("category", "band", label.alias("label"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("hits", F.lit(0)).alias("hits"))
    return filled.withColumn("recall", F.try_divide(F.col("hits").cast("double"), F.col("total").cast("double")))


def splits_and_merges(found_pairs: DataFrame, cover: float = 0.5) -> DataFrame:
    """Per category: references that hold ``cover`` of two or more predictions each, predictions that hold ``cover`` of two or more references."""
    def crowded(one: str, area: str) -> DataFrame:
        held = found_pairs.where(F.col("inter") >= cover * F.col(area)).groupBy("category", one).count()
        return held.where("count >= 2").groupBy("category").agg(F.count("*").alias("n"))

    base = found_pairs.select("category").distinct()
    splits, merges = crowded("ref_id", "pred_area").withColumnRenamed("n", "false_splits"), crowded("pred_id", "ref_area").withColumnRenamed("n", "false_merges")
    return base.join(splits, "category", "left").join(merges, "category", "left").select("category", F.coalesce("false_splits", F.lit(0)).alias("false_splits"), F.coalesce("false_merges", F.lit(0)).alias("false_merges"))


def semantic(pred: DataFrame, ref: DataFrame, height: int) -> DataFrame:
    """Pixel metrics per category over unions of masks: intersection by inclusion and exclusion."""
    sides = [clip_boxes(b.select(*GROUP, "x0", "y0", "x1", "y1"), height).withColumn("_side", F.lit(k)) for b, k in ((pred, "p"), (ref, "r"))]
    strips = box_strips(sides[0].unionByName(sides[1]), GROUP)
    both = strips.withColumn("side", F.explode(F.array("_side", F.lit("u")))).drop("_side")
    areas = strip_union_area(both, [*GROUP, "side"])
    take = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("area"))), F.lit(0))
    sums = areas.groupBy("category").agg(take("p").alias("pred_px"), take("r").alias("ref_px"), take("u").alias("union_px")).withColumn("inter_px", F.col("pred_px") + F.col("ref_px") - F.col("union_px"))
    i, a, b = F.col("inter_px"), F.col("pred_px"), F.col("ref_px")
    return sums.withColumns({"iou": G.ratio(i, F.col("union_px")), "dice": G.ratio(2 * i, a + b), "precision": G.ratio(i, a), "recall": G.ratio(i, b)})


def image_scores(found: DataFrame) -> DataFrame:
    """Per image precision, recall and F1 over all categories."""
    count = lambda k: F.sum((F.col("kind") == k).cast("long"))
    sums = found.groupBy("image_id").agg(count("tp").alias("tp"), count("fp").alias("fp"), count("fn").alias("fn"), F.countDistinct("category").alias("categories"))
    ratios = metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.lit(0))
    return sums.select("*", *[ratios[k].alias(k) for k in ("precision", "recall", "f1")])
