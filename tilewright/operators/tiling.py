"""Tile planning over images: grids, cores, classification and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.operators.spatial import range_join


def starts(length: Column, size: int, step: int) -> Column:
    """Every step from 0 while a tile ends inside, plus the last tile flush with the end; [0] if one tile suffices."""
    inner = F.sequence(F.lit(0), F.greatest(length - size - 1, F.lit(0)), F.lit(step))
    return F.when(length <= size, F.array(F.lit(0))).otherwise(F.concat(inner, F.array((length - size).cast("int"))))


def grid(images: DataFrame, size: int = 256, overlap: float = 0.25, presented: int = 256) -> DataFrame:
    """(image_id, tile, x0, y0, x1, y1, scale): rows from the top, columns from the left."""
    step = max(1, round(size * (1 - overlap)))
    ys = images.select(F.col("id").alias("image_id"), "width", "height", F.posexplode(starts(F.col("height"), size, step)).alias("row", "y0"))
    xs = ys.select("*", F.posexplode(starts(F.col("width"), size, step)).alias("column", "x0"), F.size(starts(F.col("width"), size, step)).alias("columns"))
    x1, y1 = F.least(F.col("x0") + size, F.col("width")), F.least(F.col("y0") + size, F.col("height"))
    longest = F.greatest(x1 - F.col("x0"), y1 - F.col("y0"))
    return xs.select("image_id", (F.col("row") * F.col("columns") + F.col("column")).cast("int").alias("tile"), "x0", "y0", x1.alias("x1"), y1.alias("y1"), F.least(F.lit(1.0), F.lit(float(presented)) / longest).alias("scale"))


def axis_spans(tiles: DataFrame, key: str = "image_id") -> DataFrame:
    """(image_id, xs, ys): the distinct spans of an image's tiles on each axis; as many as rows and columns, not tiles."""
    span = lambda a: F.array_sort(F.collect_set(F.struct(F.col(f"{a}0").alias("a"), F.col(f"{a}1").alias("b"))))
    return tiles.groupBy(key).agg(span("x").alias("xs"), span("y").alias("ys"))


def cores(tiles: DataFrame) -> DataFrame:
    """Grid tiles with their cores cx0 … cy1: what no overlapping tile of the image shares on that axis."""
    out = tiles.join(axis_spans(tiles), "image_id")
    ends = []
    for axis in "xy":
        ends += [
            F.expr(f"greatest({axis}0, array_max(transform(filter({axis}s, s -> s.a < {axis}0 AND {axis}0 < s.b), s -> s.b)))").alias(f"c{axis}0"),
            F.expr(f"least({axis}1, array_min(transform(filter({axis}s, s -> s.a < {axis}1 AND {axis}1 < s.b), s -> s.a)))").alias(f"c{axis}1"),
        ]
    return out.select(*tiles.columns, *ends)


def unambiguous(box: str, core: str, width: Column, height: Column) -> Column:
    """Strictly inside the core on every side that is not an image edge."""
    (x0, x1), (y0, y1) = G.side(box, "x"), G.side(box, "y")
    (c0, c1), (d0, d1) = G.side(core, "x"), G.side(core, "y")
    return ((x0 > c0) | (c0 <= 0)) & ((y0 > d0) | (d0 <= 0)) & ((x1 < c1) | (c1 >= width)) & ((y1 < d1) | (d1 >= height))


def truncated(box: str, tile: str, margin: Column, width: Column, height: Column) -> Column:
    """Within ``margin`` of a tile side that is not an image edge."""
    (x0, x1), (y0, y1) = G.side(box, "x"), G.side(box, "y")
    (t0, t1), (u0, u1) = G.side(tile, "x"), G.side(tile, "y")
    return ((x0 < t0 + margin) & (t0 > 0)) | ((y0 < u0 + margin) & (u0 > 0)) | ((x1 > t1 - margin) & (t1 < width)) | ((y1 > u1 - margin) & (u1 < height))


def detect_boxes(scenes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Deterministic detector: every scene box clipped to every tile of its image that it meets, in image pixels.

    Boxes and tiles meet through a grid of cells as wide as the tiles, not pair by pair.
    """
    side = tiles.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0]
    corner = ("x0", "y0", "x1", "y1")
    seen = range_join(scenes.select("image_id", "ann_id", "score", *corner), tiles.select("image_id", "tile", *corner), ["image_id"], cell=max(1, int(side or 1)))
    clip = [(F.greatest if c.endswith("0") else F.least)(f"a_{c}", f"b_{c}").alias(c) for c in corner]
    return seen.select("image_id", F.col("b_tile").alias("tile"), F.col("a_ann_id").alias("ann_id"), F.col("a_score").alias("score"), *clip)


def pack(ordered: DataFrame, position: str, k: int, side: int) -> DataFrame:
    """Canvas and cell of the i-th small tile when k by k share a canvas of ``side``."""
    i = F.col(position)
    cell = side // k
    inside = i % (k * k)
    x, y = (inside % k) * cell, F.floor(inside / k) * cell
    return ordered.select("*", F.floor(i / (k * k)).cast("long").alias("canvas"), x.cast("long").alias("cell_x"), y.cast("long").alias("cell_y"))


def first_slot(detections: DataFrame, slots: DataFrame) -> DataFrame:
    """Detections handed to the lowest slot whose cell holds their centre (half-open)."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    held = detections.join(slots, "canvas").where((cx >= F.col("cell_x")) & (cx < F.col("cell_x") + F.col("cell_w")) & (cy >= F.col("cell_y")) & (cy < F.col("cell_y") + F.col("cell_h")))
    return held.groupBy("ann_id").agg(F.min("slot").alias("slot"))


def to_local(box: str, tile: str, scale: Column) -> dict[str, Column]:
    """A box's corners in the pixels that a model sees of a tile."""
    return {f"{a}{k}": (F.col(f"{box}{a}{k}") - F.col(f"{tile}{a}0")) * scale for a in "xy" for k in (0, 1)}


def to_global(box: str, tile: str, scale: Column) -> dict[str, Column]:
    """The inverse of to_local."""
    return {f"{a}{k}": F.col(f"{box}{a}{k}") / scale + F.col(f"{tile}{a}0") for a in "xy" for k in (0, 1)}


def presented_size(tile: str, scale: Column) -> list[Column]:
    """Width and height of a tile as presented: at least one pixel."""
    return [F.greatest(F.rint((F.col(f"{tile}{a}1") - F.col(f"{tile}{a}0")) * scale), F.lit(1.0)).cast("long").alias(n) for a, n in (("x", "out_w"), ("y", "out_h"))]


def prompts(boxes: DataFrame, tiles: DataFrame) -> DataFrame:
    """(image_id, tile, ann_id, positive, box): the boxes of a request that lie in a tile, in its presented pixels."""
    corner = ("x0", "y0", "x1", "y1")
    held = range_join(boxes.select("image_id", "ann_id", "positive", *corner), tiles.select("image_id", "tile", "scale", *corner), ["image_id"])
    inside = " AND ".join(f"a_{a}0 >= b_{a}0 AND a_{a}1 <= b_{a}1" for a in "xy")
    moved = to_local("a_", "b_", F.col("b_scale"))
    return held.where(inside).select("image_id", F.col("b_tile").alias("tile"), F.col("a_ann_id").alias("ann_id"), F.col("a_positive").alias("positive"), *[c.alias(n) for n, c in moved.items()])


def shown_pixel(pixel: Column, shown: Column, source: Column) -> Column:
    """The source pixel that a pixel of an enlarged or reduced raster shows."""
    return F.floor(pixel * source / shown).cast("long")
