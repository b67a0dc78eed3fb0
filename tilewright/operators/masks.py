"""Masks as disjoint rectangles: runs of equal neighbouring pixel columns, joined.

A rectangle row holds the mask's keys and x0, y0, x1, y1, half open.  Areas, overlaps and
moments of masks are sums over rectangles or pairs of them, so no pixel is a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.operators.runs import box_strips
from tilewright.operators.spatial import range_join

GROUP = ("image_id", "category")


def rectangles(runs: DataFrame, keys: Sequence[str], height: int) -> DataFrame:
    """Rectangles of masks given as disjoint runs of the offset x * height + y; a run over several columns is cut at their ends."""
    column = F.explode(F.sequence(F.floor(F.col("start") / height), F.floor((F.col("end") - 1) / height)))
    cut = runs.select(*keys, "start", "end", column.alias("x")).select(
        *keys, "x", F.greatest(F.col("start") - F.col("x") * height, F.lit(0)).alias("y0"), F.least(F.col("end") - F.col("x") * height, F.lit(height)).alias("y1")
    )
    by = W.partitionBy(*keys, "y0", "y1").orderBy("x")
    lane = cut.withColumn("_lane", F.col("x") - F.row_number().over(by))
    return lane.groupBy(*keys, "y0", "y1", "_lane").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("_lane")


def column_runs(rects: DataFrame, keys: Sequence[str], height: int) -> DataFrame:
    """(keys, start, end): one run per column of every rectangle."""
    return rects.select(*keys, "y0", "y1", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x")).select(*keys, (F.col("x") * height + F.col("y0")).alias("start"), (F.col("x") * height + F.col("y1")).alias("end"))


def mask_area(rects: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rects.groupBy(*keys).agg(F.sum(G.area("")).alias("area"))


def mask_shape(rects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area, tight box and centroid at pixel centres."""
    n = G.area("")
    mean = lambda axis: F.sum((F.col(f"{axis}0") + F.col(f"{axis}1")) * n).cast("double") / (2 * F.sum(n)).cast("double")
    return rects.groupBy(*keys).agg(F.sum(n).alias("area"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), mean("x").alias("cx"), mean("y").alias("cy"))


def mask_pairs(pred: DataFrame, ref: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Masks of one group that share a pixel: areas, shared pixels and IoU.  Rows of both sides: group, ann_id, rectangle."""
    cols = [*group, "ann_id", "x0", "y0", "x1", "y1"]
    met = range_join(pred.select(*cols), ref.select(*cols), list(group))
    inter = met.groupBy(*group, F.col("a_ann_id").alias("pred_id"), F.col("b_ann_id").alias("ref_id")).agg(F.sum(G.overlap("a_", "b_")).alias("inter"))
    area = lambda side, name: mask_area(side, [*group, "ann_id"]).select(*group, F.col("ann_id").alias(f"{name}_id"), F.col("area").alias(f"{name}_area"))
    both = inter.join(area(pred, "pred"), [*group, "pred_id"]).join(area(ref, "ref"), [*group, "ref_id"])
    return both.select(*group, "pred_id", "ref_id", "pred_area", "ref_area", "inter", G.ratio(F.col("inter"), F.col("pred_area") + F.col("ref_area") - F.col("inter")).alias("iou"))


def index_instances(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations with their file and category names; those of an unknown image or category, and polygons, go.

    Names count as written but for backslashes, which separate folders as slashes do.
    """
    files = images.select(F.col("id").alias("image_id"), posix(F.col("file_name")).alias("file_name"))
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return annotations.where("counts IS NOT NULL").join(files, "image_id").join(names, "category_id")


def posix(name: Column) -> Column:
    return F.regexp_replace(name, r"\\", "/")


def scored_spine(files: DataFrame, categories: DataFrame, ref: DataFrame, pred: DataFrame) -> DataFrame:
    """Every file with every category that both sides know, and how many masks each side has there, none included."""
    wanted = categories.join(pred.select("category").distinct(), "category", "left_semi").join(ref.select("category").distinct(), "category", "left_semi")
    spine = files.join(F.broadcast(wanted.groupBy().agg(F.collect_set("category").alias("cs")))).select("file_name", F.explode("cs").alias("category"))  # one row of label names
    count = lambda side, name: side.groupBy("file_name", "category").agg(F.count("*").alias(name))
    out = spine.join(count(ref, "n_ref"), ["file_name", "category"], "left").join(count(pred, "n_pred"), ["file_name", "category"], "left")
    return out.select("file_name", "category", F.coalesce("n_ref", F.lit(0)).alias("n_ref"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"))


# ------------------------------------------------------------- windows


def inside_window(rects: DataFrame, window: str = "w_") -> DataFrame:
    """Rectangles cut to a window of the same row (columns w_x0 …), in window coordinates; empty ones go."""
    edges = {f"{a}{k}": (F.greatest if k == 0 else F.least)(f"{a}{k}", f"{window}{a}{k}") - F.col(f"{window}{a}0") for a in "xy" for k in (0, 1)}
    return rects.withColumns(edges).where("x0 < x1 AND y0 < y1")


def outside_window(rects: DataFrame, window: str = "w_") -> DataFrame:
    """The rectangles less a window of the same row: what is left, right, above and below of it."""
    low, high = {a: F.greatest(f"{a}0", f"{window}{a}0") for a in "xy"}, {a: F.least(f"{a}1", f"{window}{a}1") for a in "xy"}
    meets = (low["x"] < high["x"]) & (low["y"] < high["y"])
    part = lambda x0, x1, y0, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    around = F.array(part(x0, low["x"], y0, y1), part(high["x"], x1, y0, y1), part(low["x"], high["x"], y0, low["y"]), part(low["x"], high["x"], high["y"], y1))
    pieces = F.when(meets, F.filter(around, lambda r: (r["x0"] < r["x1"]) & (r["y0"] < r["y1"]))).otherwise(F.array(part(x0, x1, y0, y1)))
    rest = [c for c in rects.columns if c not in ("x0", "y0", "x1", "y1")]
    return rects.select(*rest, F.explode(pieces).alias("p")).select(*rest, "p.*")


def replace_window(rects: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Masks whose window takes the patch's pixels.  ``patch``: keys, window w_x0 …, and rectangles in window coordinates (null x0: an empty patch)."""
    windows = patch.select(*keys, *[f"w_{c}" for c in ("x0", "y0", "x1", "y1")]).distinct()
    kept = outside_window(rects.join(windows, list(keys), "left").na.fill(0, [f"w_{c}" for c in ("x0", "y0", "x1", "y1")]))
    cols = [*keys, "x0", "y0", "x1", "y1"]
    placed = {f"{a}{k}": F.col(f"{a}{k}") + F.col(f"w_{a}0") for a in "xy" for k in (0, 1)}
    return kept.select(*cols).unionByName(patch.where("x0 IS NOT NULL").withColumns(placed).select(*cols))


def upscaled(rects: DataFrame, low: Column, high: Column, axis: str) -> DataFrame:
    """Rectangles of a mask of ``low`` pixels on an axis on a grid of ``high``: pixel i of the large one shows i * low div high."""
    edge = lambda c: F.ceil(F.col(c) * high / low).cast("long")
    return rects.withColumns({f"{axis}0": edge(f"{axis}0"), f"{axis}1": edge(f"{axis}1")}).where(f"{axis}0 < {axis}1")


def sampled(rects: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """(keys, x, y): points of the grid of every ``step``-th pixel that lie in a mask."""
    first = lambda axis: F.ceil(F.col(f"{axis}0") / step) * step
    held = rects.where((first("x") < F.col("x1")) & (first("y") < F.col("y1")))
    columns = held.select(*keys, "y0", "y1", F.explode(F.sequence(first("x"), F.col("x1") - 1, F.lit(step).cast("long"))).alias("x"))
    return columns.select(*keys, "x", F.explode(F.sequence(first("y"), F.col("y1") - 1, F.lit(step).cast("long"))).alias("y"))


# ------------------------------------------------------------- rows and payloads


def to_annotation(shapes: DataFrame) -> DataFrame:
    """Shapes (area, tight box) as annotation rows: bbox as x, y, width, height with two places, iscrowd 0, score where set."""
    two = lambda c: G.places(c.cast("double"), 2)
    bbox = F.array(two(F.col("x0")), two(F.col("y0")), two(F.col("x1") - F.col("x0")), two(F.col("y1") - F.col("y0")))
    return shapes.select(*[c for c in shapes.columns if c not in ("x0", "y0", "x1", "y1", "cx", "cy", "area")], bbox.alias("bbox"), F.col("area").cast("double").alias("area"), F.lit(0).alias("iscrowd"))


def wire(rows: DataFrame) -> DataFrame:
    """Payload fields: score with four places, bbox and centroid with two; a missing centroid is the box's centre."""
    two = lambda c: G.places(c.cast("double"), 2)
    centre = lambda a: F.coalesce(F.col(f"c{a}"), (F.col(f"{a}0") + F.col(f"{a}1")) / 2)
    return rows.select("image_id", "ann_id", G.places(F.col("score"), 4).alias("score"), *[two(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")], two(centre("x")).alias("cx"), two(centre("y")).alias("cy"))


def integer_rect(prefix: str = "") -> list[Column]:
    """Tight rectangle of whole pixels; (0, 0, 1, 1) for an empty or missing box."""
    cols = {c: F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")}
    held = F.coalesce((cols["x0"] < cols["x1"]) & (cols["y0"] < cols["y1"]), F.lit(False))
    whole = {c: (F.floor if c.endswith("0") else F.ceil)(v).cast("long") for c, v in cols.items()}
    return [F.when(held, whole[c]).otherwise(F.lit(0 if c.endswith("0") else 1)).alias(c) for c in cols]


def checked_size(masks: DataFrame) -> DataFrame:
    """Masks whose size is their image's; any other raises as the rows are read."""
    wrong = (F.col("height") != F.col("image_height")) | (F.col("width") != F.col("image_width"))
    return masks.withColumn("height", F.when(wrong, F.raise_error(F.concat(F.lit("mask size differs from image "), F.col("image_id").cast("string"))).cast("int")).otherwise(F.col("height")))


def mask_key(counts: Column) -> Column:
    """Key of a mask by its content."""
    return F.sha1(counts)


# ------------------------------------------------------------- unions and covers


def union_rects(rects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Disjoint rectangles of the union: strips between neighbouring bounds, y intervals merged in each."""
    strips = box_strips(rects.select(*keys, "x0", "y0", "x1", "y1"), keys)
    one = strips.groupBy(*keys, "x", "width", "y0").agg(F.max("y1").alias("y1"))
    by = W.partitionBy(*keys, "x").orderBy("y0")
    fresh = one.withColumn("_new", (F.coalesce(F.max("y1").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1)) < F.col("y0")).cast("int"))
    island = fresh.withColumn("_k", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*keys, "x", "width", "_k").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1")).select(*keys, F.col("x").alias("x0"), "y0", (F.col("x") + F.col("width")).alias("x1"), "y1")


def covered_share(masks: DataFrame, others: DataFrame, key: str, group: Sequence[str]) -> DataFrame:
    """(group, key, share): how much of every mask the union of the others of its group covers, itself left out."""
    cols = [*group, key, "x0", "y0", "x1", "y1"]
    met = range_join(masks.select(*cols), others.select(*cols), list(group)).where(f"a_{key} <> b_{key}")
    shared = met.select(*group, F.col(f"a_{key}").alias(key), *[(F.greatest if c.endswith("0") else F.least)(f"a_{c}", f"b_{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    covered = mask_area(union_rects(shared, [*group, key]), [*group, key]).withColumnRenamed("area", "covered")
    return mask_area(masks, [*group, key]).join(covered, [*group, key], "left").select(*group, key, G.ratio(F.coalesce("covered", F.lit(0)), F.col("area")).alias("share"))


def export_masks(images: DataFrame, rects: DataFrame, labels: Sequence[str], force: bool = False) -> DataFrame:
    """(file_name, target, area, written): per image the pixels of its chosen labels' union that an export sets to 0, all others 255.

    Images without such masks are skipped (written = false) unless ``force``, which writes them blank.
    """
    chosen = rects.where(F.col("category").isin(list(labels)))
    union = mask_area(union_rects(chosen, ["image_id"]), ["image_id"])
    target = F.concat(F.regexp_replace("file_name", r"\.[^./\\]*$", ""), F.lit("_mask.tiff"))
    out = images.select(F.col("id").alias("image_id"), "file_name").join(union, "image_id", "left")
    return out.select("file_name", target.alias("target"), F.coalesce("area", F.lit(0)).cast("long").alias("area"), (F.col("area").isNotNull() | F.lit(force)).alias("written"))


def distinct_masks(masks: DataFrame) -> DataFrame:
    """(key, uses): every mask content once, as a cache holds it, with how many masks show it."""
    return masks.groupBy(mask_key(F.col("counts")).alias("key")).agg(F.count("*").alias("uses"))


def sample_step(side: Column, limit: int = 2016) -> Column:
    """Step at which a side of more than ``limit`` pixels is thinned."""
    return F.greatest(F.ceil(side / limit), F.lit(1)).cast("long")
