"""Order-dependent folds: one-to-one matching and seeded grouping.

Each fold runs inside the group's own row as a higher-order aggregate over its sorted
edges, so nothing leaves the JVM.  Groups are one image and category.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy_match(edges: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """One-to-one pairs (keys, pred, ref, iou), highest IoU first, then highest pred, then highest ref."""
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("iou")).alias("down"), (-F.col("pred")).alias("p"), (-F.col("ref")).alias("r"))))
    picked = """aggregate(ranked, cast(array() as array<struct<down: double, p: bigint, r: bigint>>),
        (done, e) -> IF(exists(done, x -> x.p = e.p OR x.r = e.r), done, concat(done, array(e))))"""
    return (
        edges.where(F.col("iou") >= threshold)
        .groupBy(*keys)
        .agg(ranked.alias("ranked"))
        .select(*keys, F.explode(F.expr(picked)).alias("m"))
        .select(*keys, (-F.col("m.p")).alias("pred"), (-F.col("m.r")).alias("ref"), (-F.col("m.down")).alias("iou"))
    )


def seeded_groups(boxes: DataFrame, pairs: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """(keys, ann_id, seed): members taken by seeds in score order (then id); a member's IoU is with its seed.

    ``pairs`` has (keys, a, b, iou) in both directions.  Grouping is not transitive.
    """
    near = pairs.where(F.col("iou") >= threshold).groupBy(*keys, F.col("a").alias("ann_id")).agg(F.collect_list("b").alias("near"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.coalesce("score", F.lit(float("inf")))).alias("down"), F.col("ann_id"), F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))))
    fold = """aggregate(ranked, cast(array() as array<struct<id: bigint, seed: bigint>>),
        (done, e) -> IF(exists(done, x -> x.id = e.ann_id), done,
            concat(done, array(named_struct('id', e.ann_id, 'seed', e.ann_id)),
                transform(filter(e.near, n -> NOT exists(done, x -> x.id = n)), n -> named_struct('id', n, 'seed', e.ann_id)))))"""
    return (
        boxes.join(near, [*keys, "ann_id"], "left")
        .groupBy(*keys)
        .agg(ranked.alias("ranked"))
        .select(*keys, F.explode(F.expr(fold)).alias("m"))
        .select(*keys, F.col("m.id").alias("ann_id"), F.col("m.seed").alias("seed"))
    )
