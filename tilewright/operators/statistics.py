"""Directory statistics and review views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 20


def image_counts(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """(file_name, category, n): images without annotations keep one row of null category and 0."""
    n = annotations.groupBy("image_id", "category").agg(F.count("*").alias("n"))
    return images.select(F.col("id").alias("image_id"), "file_name").join(n, "image_id", "left").select("file_name", "category", F.coalesce("n", F.lit(0)).alias("n"))


def area_bin(area: Column) -> Column:
    """Twenty powers of two from 16; smaller and larger areas clamp to the ends."""
    return F.least(F.greatest(F.length(F.bin(area.cast("long"))) - 5, F.lit(0)), F.lit(BINS - 1))


def area_histogram(annotations: DataFrame) -> DataFrame:
    """Per category and occupied bin the count, with the category's extremes."""
    a = F.col("w") * F.col("h")
    by_bin = annotations.select("category", area_bin(a).alias("bin"), a.alias("area"), "w", "h").groupBy("category", "bin").agg(
        F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("area", "w", "h") for k, f in (("min", F.min), ("max", F.max))]
    )
    whole = W.partitionBy("category")
    extremes = [(F.min if c.startswith("min") else F.max)(c).over(whole).alias(c) for c in ("min_area", "max_area", "min_w", "max_w", "min_h", "max_h")]
    return by_bin.select("category", "bin", "n", *extremes)


def category_totals(categories: DataFrame, annotations: DataFrame, image: int) -> DataFrame:
    """Per category its annotations in all and in one image; categories without any count 0."""
    n = annotations.groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.col("image_id") == image).alias("here"))
    return categories.select("id", F.col("name").alias("category")).join(n, "category", "left").select("id", "category", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("here", F.lit(0)).alias("here"))


def neighbors(images: DataFrame) -> DataFrame:
    """(file_name, position, previous, next) in listing order.

    Listing order is a global sort; numbers come from one partition only because a
    directory listing is bounded, and images carry their directory as partition.
    """
    by = W.partitionBy("directory").orderBy(F.lower("file_name"), "file_name")
    return images.select("directory", "file_name", (F.row_number().over(by) - 1).alias("position"), F.lag("file_name").over(by).alias("previous"), F.lead("file_name").over(by).alias("next"))


def top_rows(annotations: DataFrame, per: Sequence[str], limit: int) -> DataFrame:
    """At most ``limit`` best-scored rows per group, with the number left out.

    Groups are counted apart from the ranking, so that the rank filter can cut groups before their shuffle.
    """
    by = W.partitionBy(*per).orderBy(F.col("score").desc(), "ann_id")
    best = annotations.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)
    hidden = annotations.groupBy(*per).agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("hidden"))
    return best.join(hidden, list(per))


def typical_sized(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Boxes whose area lies within one population deviation of the group's mean.

    With integer areas the test is exact: (n a - s)^2 <= n q - s^2.
    """
    a = (F.col("w") * F.col("h")).cast("decimal(38,0)")
    sums = boxes.groupBy(*keys).agg(F.count("*").cast("decimal(38,0)").alias("_n"), F.sum(a).cast("decimal(38,0)").alias("_s"), F.sum(a * a).cast("decimal(38,0)").alias("_q"))
    off = (F.col("_n") * a - F.col("_s")).cast("decimal(19,0)")
    return boxes.join(sums, list(keys)).where((off * off) <= (F.col("_n") * F.col("_q") - F.col("_s") * F.col("_s"))).select(*boxes.columns)


def outliers(images: DataFrame, annotations: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(image_id, category, n, flag): an image without the label, or over two deviations from the label's mean."""
    n = annotations.groupBy("image_id", "category").agg(F.count("*").alias("n"))
    spine = images.select(F.col("id").alias("image_id"), F.explode(F.array(*[F.lit(x) for x in labels])).alias("category"))
    full = spine.join(n, ["image_id", "category"], "left").select("image_id", "category", F.coalesce("n", F.lit(0)).alias("n"))
    sums = full.groupBy("category").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    off = F.col("c") * F.col("n") - F.col("s")
    far = off * off > 4 * (F.col("c") * F.col("q") - F.col("s") * F.col("s"))
    return full.join(F.broadcast(sums), "category").select("image_id", "category", "n", ((F.col("n") == 0) | far).alias("flag"))


def tri_state(counts: DataFrame, required: Sequence[str], excluded: Sequence[str]) -> DataFrame:
    """Images that hold every required label and no excluded one."""
    tests = [F.count_if((F.col("category") == x) & (F.col("n") > 0)) > 0 for x in required]
    tests += [F.count_if((F.col("category") == x) & (F.col("n") > 0)) == 0 for x in excluded]
    keep = F.lit(True)
    for t in tests:
        keep = keep & t
    return counts.groupBy("image_id").agg(keep.alias("keep")).where("keep").select("image_id")


def dominant(annotations: DataFrame, per: Sequence[str]) -> DataFrame:
    """Most frequent label; among equals the one seen first."""
    n = annotations.groupBy(*per, "category").agg(F.count("*").alias("n"), F.min("ann_id").alias("first"))
    best = F.max_by(F.struct("category", "n"), F.struct("n", -F.col("first"))).alias("best")
    return n.groupBy(*per).agg(best).select(*per, "best.category", "best.n")


def thousandths(value: Column) -> Column:
    """Rounding to three places, ties up, by one rule that every engine computes alike."""
    return F.floor(value * 1000 + F.lit(0.5)) / F.lit(1000.0)


def pace(samples: DataFrame, key: str, value: str, order: str, alpha: float = 0.3) -> DataFrame:
    """Exponentially weighted mean per key, started by the first positive sample and rounded to three places a step.

    Rounding makes each step depend on the one before, so a key's samples fold in order in one row.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.when(F.col(value) > 0, F.struct(order, value)))), lambda s: s[value])
    step = lambda acc, x: F.when(acc.isNull(), thousandths(x)).otherwise(thousandths(F.lit(alpha) * x + F.lit(1 - alpha) * acc))
    return samples.groupBy(key).agg(ordered.alias("v")).select(key, F.aggregate("v", F.lit(None).cast("double"), step).alias("pace"))
