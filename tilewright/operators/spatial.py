"""Joins of boxes by overlap or distance, through grid bins.

A pure range condition would be planned as a nested loop.  Both sides are instead
exploded over the grid cells that they touch and joined on cell, and a pair counts in
one cell only: the one that holds the corner at which both boxes begin.  No pair has
to be de-duplicated by a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geometry as G


def _binned(boxes: DataFrame, prefix: str, cell: int, reach: Column) -> DataFrame:
    for axis in "xy":
        low, high = G.side(prefix, axis)
        first, last = F.floor((low - reach) / cell), F.floor((high + reach) / cell)
        boxes = boxes.withColumn(f"_{axis}_first_{prefix}", first).withColumn(f"_{axis}", F.explode(F.sequence(first, last)))
    return boxes


def cell_side(*sides: DataFrame) -> int:
    """Cell for joins of these boxes: their median long side, so that a usual box touches few cells and few boxes share one."""
    found = [r[0] for b in sides for r in b.select(F.percentile_approx(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("double"), 0.5, 200)).collect()]
    return max(1, ceil(max((x for x in found if x is not None), default=1)))


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: int | None = None, within: float = 0) -> DataFrame:
    """Pairs of equal keys whose boxes (a_…, b_… after the join) overlap strictly, or lie at most ``within`` apart.

    Columns of the left come back with prefix a_, of the right with b_, the keys plain.
    Without ``cell`` the boxes' median side is measured first.
    """
    if cell is None:
        cell = cell_side(left) if left is right else cell_side(left, right)
    a = left.select(*[F.col(c) if c in keys else F.col(c).alias(f"a_{c}") for c in left.columns])
    b = right.select(*[F.col(c) if c in keys else F.col(c).alias(f"b_{c}") for c in right.columns])
    test = G.intersects("a_", "b_") if within == 0 else G.gap("a_", "b_") <= within
    joined = _binned(a, "a_", cell, F.lit(within)).join(_binned(b, "b_", cell, F.lit(0)), [*keys, "_x", "_y"])
    begins = (F.col("_x") == F.greatest("_x_first_a_", "_x_first_b_")) & (F.col("_y") == F.greatest("_y_first_a_", "_y_first_b_"))
    return joined.where(begins & test).drop("_x", "_y", *[f"_{x}_first_{p}" for x in "xy" for p in ("a_", "b_")])


def neighbor_counts(boxes: DataFrame, keys: Sequence[str], ident: str, cell: int | None = None) -> DataFrame:
    """Per box how many centres (its own included) lie within half its longer side of its centre on both axes."""
    cell = cell_side(boxes) if cell is None else cell
    twice = boxes.select(*keys, ident, (F.col("x0") + F.col("x1")).alias("cx"), (F.col("y0") + F.col("y1")).alias("cy"), F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("reach"))
    a = twice.withColumn("gx", F.explode(F.sequence(F.floor((F.col("cx") - F.col("reach")) / (2 * cell)), F.floor((F.col("cx") + F.col("reach")) / (2 * cell)))))
    a = a.withColumn("gy", F.explode(F.sequence(F.floor((F.col("cy") - F.col("reach")) / (2 * cell)), F.floor((F.col("cy") + F.col("reach")) / (2 * cell)))))
    b = twice.select(*keys, F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.floor(F.col("cx") / (2 * cell)).alias("gx"), F.floor(F.col("cy") / (2 * cell)).alias("gy"))
    near = (F.abs(F.col("ox") - F.col("cx")) <= F.col("reach")) & (F.abs(F.col("oy") - F.col("cy")) <= F.col("reach"))
    return a.join(b, [*keys, "gx", "gy"]).where(near).groupBy(*keys, ident).agg(F.count("*").alias("neighbors"))


def relation(pairs: DataFrame, dup_iou: float = 0.5, dup_ios: float = 0.8, gate: bool = True) -> DataFrame:
    """``relation`` of box a_ (new) to box b_ (accepted): dup, subsumes or none, tested in this order."""
    out = F.when(G.iou("a_", "b_") >= dup_iou, "dup")
    if gate:
        out = out.when(G.cover("a_", "b_") >= dup_ios, "dup").when(G.cover("b_", "a_") >= dup_ios, "subsumes")
    return pairs.withColumn("relation", out.otherwise("none"))


def smallest_under(points: DataFrame, boxes: DataFrame, keys: Sequence[str], point: str) -> DataFrame:
    """Per point the id (ann_id) of the smallest box that holds it, inclusive; ties by id."""
    cell = cell_side(boxes)
    p = points.withColumn("_x", F.floor(F.col("px") / cell)).withColumn("_y", F.floor(F.col("py") / cell))
    held = p.join(_binned(boxes.select(*keys, "ann_id", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")]), "b_", cell, F.lit(0)), [*keys, "_x", "_y"])
    held = held.where(F.col("px").between(F.col("b_x0"), F.col("b_x1")) & F.col("py").between(F.col("b_y0"), F.col("b_y1")))
    return held.groupBy(*keys, point).agg(F.min_by("ann_id", F.struct(G.area("b_"), F.col("ann_id"))).alias("ann_id"))
