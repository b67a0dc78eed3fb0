"""Masks as coarse grids: a mask's box cut into at most 32 by 32 cells, those that hold a pixel.

Distances, covers and relations of masks are joins of cells, whose number per mask is
bounded, so they cost the same for a mask of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.operators.masks import mask_shape
from tilewright.operators.spatial import range_join

SIDE = 32
#: A cell's number is its column times this plus its row; wider than a grid, so that neighbours do not wrap.
CODE = 100


def snapshots(rects: DataFrame, keys: Sequence[str], side: int = SIDE) -> DataFrame:
    """(keys, gx, gy, box columns, gw, gh): the cells with a pixel of every mask; pixel i of n shows in cell i * g div n.

    A mask's cells form as one array in its row and explode once, at the end.
    """
    shape = mask_shape(rects, keys).select(*keys, *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    shape = shape.withColumn("gw", F.least(F.col("bx1") - F.col("bx0"), F.lit(side))).withColumn("gh", F.least(F.col("by1") - F.col("by0"), F.lit(side)))
    cut = rects.select(*keys, "x0", "y0", "x1", "y1").join(shape, list(keys))

    def cells(axis: str, grid: str) -> Column:
        n = F.col(f"b{axis}1") - F.col(f"b{axis}0")
        at = lambda c: F.floor((c - F.col(f"b{axis}0")) * F.col(grid) / n)
        return F.sequence(at(F.col(f"{axis}0")), at(F.col(f"{axis}1") - 1))

    box = ("bx0", "by0", "bx1", "by1", "gw", "gh")
    codes = F.flatten(F.transform(cells("x", "gw"), lambda x: F.transform(cells("y", "gh"), lambda y: x * CODE + y)))
    grids = cut.select(*keys, *box, codes.alias("codes")).groupBy(*keys, *box).agg(F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes"))
    return grids.select(*keys, *box, F.explode("codes").alias("code")).select(*keys, F.floor(F.col("code") / CODE).alias("gx"), (F.col("code") % CODE).alias("gy"), *box)


def placed(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells as rectangles x0 … y1 in image pixels."""
    edge = lambda axis, grid, step: F.col(f"b{axis}0") + (F.col(f"g{axis}") + step) * (F.col(f"b{axis}1") - F.col(f"b{axis}0")) / F.col(grid)
    return cells.select(*keys, "gx", "gy", edge("x", "gw", 0).alias("x0"), edge("y", "gh", 0).alias("y0"), edge("x", "gw", 1).alias("x1"), edge("y", "gh", 1).alias("y1"))


def frontier(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells with a side neighbour that is empty or off the grid: all less those that stay when the grid is moved to each side."""
    box = ("bx0", "by0", "bx1", "by1", "gw", "gh")
    code = (F.col("gx") * CODE + F.col("gy")).alias("code")
    grids = cells.groupBy(*keys, *box).agg(F.collect_set(code).alias("codes"))
    moved = lambda step: F.transform("codes", lambda c: c + step)
    inner = F.array_intersect(F.array_intersect(moved(CODE), moved(-CODE)), F.array_intersect(moved(1), moved(-1)))
    edge = grids.select(*keys, *box, F.explode(F.array_except("codes", inner)).alias("code"))
    return edge.select(*keys, F.floor(F.col("code") / CODE).alias("gx"), (F.col("code") % CODE).alias("gy"), *box)


def outlines(rects: DataFrame, keys: Sequence[str], side: int = SIDE) -> DataFrame:
    """The frontier of the masks' snapshots, straight from their rectangles; a null key is no mask.

    A mask is one row from its rectangles on: each grid column is the bits of a long, so that no
    cell is a row before it is known to lie on the edge, and rectangles alone are shuffled.
    """
    if side > 62:
        raise ValueError("a grid column must fit the bits of a long")
    box = ("bx0", "by0", "bx1", "by1", "gw", "gh")
    bounds = [f(c).alias(f"b{c}") for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))]
    known = rects.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    masks = known.groupBy(*keys).agg(*bounds, F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("parts"))
    for axis, grid in (("x", "gw"), ("y", "gh")):
        masks = masks.withColumn(grid, F.least(F.col(f"b{axis}1") - F.col(f"b{axis}0"), F.lit(side)))
    at = lambda c, axis, grid: f"floor(({c} - b{axis}0) * {grid} / (b{axis}1 - b{axis}0))"
    low, high = at("r.y0", "y", "gh"), at("r.y1 - 1", "y", "gh")
    bits = f"shiftleft(shiftleft(1L, cast({high} - {low} + 1 as int)) - 1, cast({low} as int))"
    spans = f"transform(parts, r -> struct({at('r.x0', 'x', 'gw')} as a, {at('r.x1 - 1', 'x', 'gw')} as b, {bits} as bits))"
    held = "transform(sequence(0L, gw - 1L), x -> aggregate(spans, 0L, (held, s) -> IF(x BETWEEN s.a AND s.b, held | s.bits, held)))"
    beside = lambda i: f"coalesce(get(held, cast({i} as int)), 0L)"
    edge = f"transform(held, (c, i) -> c & ~(c & shiftleft(c, 1) & shiftright(c, 1) & {beside('i - 1')} & {beside('i + 1')}))"
    grids = masks.withColumn("spans", F.expr(spans)).withColumn("held", F.expr(held)).select(*keys, *box, F.posexplode(F.expr(edge)).alias("gx", "bits"))
    cells = F.explode(F.expr("filter(sequence(0L, gh - 1L), y -> getbit(bits, cast(y as int)) = 1)"))
    return grids.where("bits <> 0").select(*keys, F.col("gx").cast("long").alias("gx"), cells.alias("gy"), *box)


def near_masks(cells: DataFrame, within: float, group: Sequence[str] = ("image_id",), key: str = "ann_id") -> DataFrame:
    """(group, a, b): pairs of masks, a < b, of which two cells lie at most ``within`` apart; masks that share a cell among them."""
    keys = [*group, key]
    edge = placed(frontier(cells, keys), keys).drop("gx", "gy")
    met = range_join(edge, edge, list(group), within=within).where(f"a_{key} < b_{key}")
    near = met.select(*group, F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"))
    # a mask that lies inside another meets none of its frontier: compare one cell of each with all cells of the others
    every = placed(cells, keys).drop("gx", "gy")
    one = every.groupBy(*keys).agg(F.min(F.struct("x0", "y0", "x1", "y1")).alias("c")).select(*keys, "c.*")
    held = range_join(one, every, list(group)).where(f"a_{key} <> b_{key}")
    inside = held.select(*group, F.least(f"a_{key}", f"b_{key}").alias("a"), F.greatest(f"a_{key}", f"b_{key}").alias("b"))
    return near.unionByName(inside).distinct()


def shared_area(cells: DataFrame, group: Sequence[str] = ("image_id",), key: str = "ann_id") -> DataFrame:
    """(group, a, b, hits, inter, cover): how many cells of a have their centre in a cell of b, that area, and its share of a."""
    keys = [*group, key]
    rect = placed(cells, keys).drop("gx", "gy")
    size = rect.groupBy(*keys).agg(F.count("*").alias("cells"), F.max(G.area("")).alias("cell"))
    centre = rect.select(*keys, ((F.col("x0") + F.col("x1")) / 2).alias("x0"), ((F.col("y0") + F.col("y1")) / 2).alias("y0"))
    centre = centre.withColumn("x1", F.col("x0")).withColumn("y1", F.col("y0"))
    held = range_join(centre, rect, list(group), within=1e-9).where(f"a_{key} <> b_{key} AND a_x0 >= b_x0 AND a_x0 < b_x1 AND a_y0 >= b_y0 AND a_y0 < b_y1")
    hits = held.groupBy(*group, F.col(f"a_{key}").alias(key), F.col(f"b_{key}").alias("b")).agg(F.count("*").alias("hits"))
    out = hits.join(size, keys)
    return out.select(*group, F.col(key).alias("a"), "b", "hits", (F.col("hits") * F.col("cell")).alias("inter"), F.least(F.col("hits") / F.col("cells"), F.lit(1.0)).alias("cover"))


def mask_relation(shared: DataFrame, areas: DataFrame, dup_iou: float = 0.5, dup_ios: float = 0.8, group: Sequence[str] = ("image_id",)) -> DataFrame:
    """(group, a, b, relation) of new mask a to accepted mask b, from cells: dup, subsumes or none, in this order.  ``areas``: group, ann_id, area."""
    back = shared.select(*group, F.col("a").alias("b"), F.col("b").alias("a"), F.col("cover").alias("held"))
    size = lambda side: areas.select(*group, F.col("ann_id").alias(side), F.col("area").alias(f"area_{side}"))
    both = shared.join(back, [*group, "a", "b"], "left").join(size("a"), [*group, "a"]).join(size("b"), [*group, "b"])
    inter = F.least("inter", "area_a", "area_b")
    iou = G.ratio(inter, F.col("area_a") + F.col("area_b") - inter)
    verdict = F.when((iou >= dup_iou) | (F.col("cover") >= dup_ios), "dup").when(F.coalesce("held", F.lit(0.0)) >= dup_ios, "subsumes").otherwise("none")
    return both.select(*group, "a", "b", verdict.alias("relation"))


def merged_blobs(covers: DataFrame, near: DataFrame, group: Sequence[str] = ("image_id",)) -> DataFrame:
    """(group, a): masks that cover two others which are not near each other.  ``covers``: group, a, b; ``near``: pairs a < b."""
    two = covers.select(*group, "a", F.col("b").alias("one")).join(covers.select(*group, "a", F.col("b").alias("two")), [*group, "a"]).where("one < two")
    close = near.select(*group, F.col("a").alias("one"), F.col("b").alias("two"))
    return two.join(close, [*group, "one", "two"], "left_anti").select(*group, "a").distinct()
