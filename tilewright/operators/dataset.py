"""Edits of an annotation dataset: images, categories and annotations as three tables.

Each edit returns new tables; nothing is written here.  Checks that must refuse the
whole edit raise before anything is returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.sources.tables import hand_over


def _refuse(rows: DataFrame, column: str, message: str) -> None:
    bad = sorted(r[0] for r in rows.select(column).distinct().limit(20).collect())
    if bad:
        raise ValueError(f"{message}: {bad}")


def label_ids(categories: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Ids of all categories with these names; an unknown name raises KeyError."""
    names = categories.select("name").distinct()
    wanted = categories.sparkSession.createDataFrame([(x,) for x in labels], "name string").distinct()
    missing = sorted(r[0] for r in wanted.join(names, "name", "left_anti").collect())
    if missing:
        raise KeyError(f"unknown labels: {missing}")
    return categories.join(F.broadcast(wanted), "name", "left_semi").select("id")


def ancestors(categories: DataFrame) -> DataFrame:
    """(name, ancestor, depth): every step up the forest by name, ending at headings and cut at cycles."""
    spark = categories.sparkSession
    parents = categories.groupBy("name").agg(F.min_by(F.coalesce("supercategory", F.lit("")), "id").alias("parent"))
    return spark.sql(
        """
        WITH RECURSIVE up(name, ancestor, depth, seen) MAX RECURSION LEVEL 64 AS (
            SELECT name, parent, 1, array(name) FROM {parents} WHERE parent <> ''
            UNION ALL
            SELECT up.name, p.parent, depth + 1, concat(seen, array(ancestor))
            FROM up JOIN {parents} p ON p.name = up.ancestor
            WHERE p.parent <> '' AND NOT array_contains(concat(seen, array(ancestor)), p.parent))
        SELECT name, ancestor, depth FROM up""",
        parents=parents,
    )


def nearest_outside(categories: DataFrame, inside: Sequence[str]) -> DataFrame:
    """(name, outside): the nearest ancestor not in ``inside``; "" where none is left."""
    up = ancestors(categories).where(~F.col("ancestor").isin(list(inside)))
    found = up.groupBy("name").agg(F.min_by("ancestor", "depth").alias("outside"))
    return categories.select("name").distinct().join(found, "name", "left").select("name", F.coalesce("outside", F.lit("")).alias("outside"))


def roll_up(categories: DataFrame, own: DataFrame) -> DataFrame:
    """(name, own, total): own counts plus those of all descendants; headings that are no label appear too."""
    counts = categories.select("name").distinct().join(own, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("own"))
    spread = counts.select("name", "own").unionAll(ancestors(categories).join(counts, "name").select(F.col("ancestor").alias("name"), "own"))
    totals = spread.groupBy("name").agg(F.sum("own").alias("total"))
    return totals.join(counts, "name", "left").select("name", F.coalesce("own", F.lit(0)).alias("own"), "total")


def drop_labels(categories: DataFrame, annotations: DataFrame, labels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Without the labels and their annotations; children move to the nearest surviving ancestor."""
    ids = label_ids(categories, labels)
    outside = nearest_outside(categories, labels)
    kept = categories.join(F.broadcast(ids), "id", "left_anti").join(outside, "name")
    moved = F.when(F.col("supercategory").isin(list(labels)), F.col("outside")).otherwise(F.coalesce("supercategory", F.lit("")))
    return kept.select("id", "name", moved.alias("supercategory")), annotations.join(F.broadcast(ids.withColumnRenamed("id", "category_id")), "category_id", "left_anti")


def merge_labels(categories: DataFrame, annotations: DataFrame, labels: Sequence[str], new_name: str) -> tuple[DataFrame, DataFrame]:
    """One label in place of several: the existing ``new_name``, else the smallest of the ids."""
    ids = label_ids(categories, labels)
    held = categories.where(F.col("name") == new_name).agg(F.min("id")).first()[0]
    target = held if held is not None else ids.agg(F.min("id")).first()[0]
    gone = ids.where(F.col("id") != target)
    vanished = [x for x in dict.fromkeys(labels) if x != new_name]
    outside = nearest_outside(categories, [*vanished, new_name])
    parent = F.coalesce("supercategory", F.lit(""))
    inside = F.col("supercategory").isin([*vanished, new_name])
    moved = (
        F.when((F.col("id") == target) & inside, F.col("outside"))
        .when((F.col("id") != target) & F.col("supercategory").isin(vanished), F.lit(new_name))
        .otherwise(parent)
    )
    kept = categories.join(F.broadcast(gone), "id", "left_anti").join(outside, "name")
    renamed = kept.select("id", F.when(F.col("id") == target, F.lit(new_name)).otherwise(F.col("name")).alias("name"), moved.alias("supercategory"))
    flagged = annotations.join(F.broadcast(gone.select(F.col("id").alias("category_id"), F.lit(True).alias("_gone"))), "category_id", "left")
    new_id = F.when(F.col("_gone"), F.lit(target)).otherwise(F.col("category_id")).cast(annotations.schema["category_id"].dataType)
    return renamed, flagged.withColumn("category_id", new_id).select(*annotations.columns)


def add_labels(categories: DataFrame, labels: Sequence[str]) -> DataFrame:
    _refuse(categories.where(F.col("name").isin(list(labels))), "name", "labels already in dataset")
    last = categories.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return categories.unionByName(categories.sparkSession.createDataFrame([(last + 1 + i, x, "") for i, x in enumerate(labels)], categories.schema))


def set_parent(categories: DataFrame, name: str, parent: str) -> DataFrame:
    """Re-parent a label; "" makes it a root.  A parent must be a label or a heading in use, and no descendant."""
    label_ids(categories, [name])
    if parent and categories.where((F.col("name") == parent) | (F.col("supercategory") == parent)).isEmpty():
        raise KeyError(f"neither label nor heading: {parent!r}")
    if parent == name or not ancestors(categories).where((F.col("name") == parent) & (F.col("ancestor") == name)).isEmpty():
        raise ValueError(f"{parent!r} lies below {name!r}")
    return categories.withColumn("supercategory", F.when(F.col("name") == name, F.lit(parent)).otherwise(F.col("supercategory")))


def append_rows(table: DataFrame, new: DataFrame, order: Sequence[str]) -> DataFrame:
    """New rows with ids after the largest, in the given order (which must be total).

    Numbers come from range partitions and their sizes, so no task sees all new rows.  The
    ranged rows are written once and then counted and numbered, so a partition that is
    computed again cannot change its numbers.
    """
    last = table.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    ranged = hand_over(new.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()), "ranged")
    ranged = ranged.withColumn("_in", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    numbered = ranged.join(F.broadcast(before.drop("_n")), "_part").withColumn("id", F.lit(last) + F.col("_before") + F.col("_in"))
    return table.unionByName(numbered.drop("_part", "_in", "_before"), allowMissingColumns=True)


def ensure_image(images: DataFrame, name: str, width: int, height: int) -> DataFrame:
    """The table with a row for this base name, appended if it has none."""
    base = F.regexp_extract("file_name", r"[^/\\]*$", 0)
    if not images.where(base == name).isEmpty():
        return images
    last = images.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return images.unionByName(images.sparkSession.createDataFrame([(last + 1, name, width, height)], images.schema))


def stale(references: DataFrame, annotations: DataFrame, drift: float = 1.0) -> DataFrame:
    """References whose annotation is gone, lies in another image or has moved by over ``drift``."""
    now = annotations.select("ann_id", F.col("image_id").alias("_image"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "w", "h")])
    moved = F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in ("x0", "y0", "w", "h")])
    return references.join(now, "ann_id", "left").where(F.col("_image").isNull() | (F.col("_image") != F.col("image_id")) | (moved > drift)).select(*references.columns)


def latest(log: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last writer per key; the position is the key's first one."""
    rest = [c for c in log.columns if c not in keys and c != order]
    return log.groupBy(*keys).agg(F.max(order).alias(order), F.min(order).alias("position"), *[F.max_by(c, order).alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], position: str = "position") -> DataFrame:
    """Rows of ``new`` in place of those of equal keys, at the old row's position; others appended at their own."""
    held = old.select(*keys, F.col(position).alias("_held"), F.lit(True).alias("_old"))
    placed = new.join(held, list(keys), "left").withColumn(position, F.when(F.col("_old"), F.col("_held")).otherwise(F.col(position))).select(*new.columns)
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(placed)


def live_events(landed: DataFrame, retracted: DataFrame, origin: Sequence[str]) -> DataFrame:
    return landed.join(retracted.select(*origin).distinct(), list(origin), "left_anti")
