"""Saves, deletions and the search index as transactions over tables.

A transaction takes the current tables and returns the new ones with a summary; nothing
is written before every check has passed.  ``Conflict`` stands for a stale request.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import dataset as D
from tilewright.sources.tables import write_atomic

INDEX_VERSION = 3


class Conflict(Exception):
    """The dataset has changed since the request's references were read."""


@dataclass(frozen=True)
class Dataset:
    images: DataFrame
    categories: DataFrame
    annotations: DataFrame


def check_fresh(references: DataFrame, annotations: DataFrame) -> None:
    """Raise Conflict with the ids of references that no longer hold; at most twenty are named."""
    gone = sorted(r[0] for r in D.stale(references, annotations).select("ann_id").distinct().limit(20).collect())
    if gone:
        raise Conflict(f"annotations have changed: {gone}")


def delete(data: Dataset, references: DataFrame) -> Dataset:
    """Without the referenced annotations; a stale reference refuses all of them."""
    check_fresh(references, data.annotations)
    return Dataset(data.images, data.categories, data.annotations.join(references.select("ann_id"), "ann_id", "left_anti"))


def save(data: Dataset, name: str, width: int, height: int, deletes: DataFrame, new: DataFrame) -> tuple[Dataset, dict[str, int]]:
    """Deletes, then the image row, then new labels by name, then the new annotations (category, box) with fresh ids.

    All references are checked before anything changes.  The counts tell what was new and deleted.
    """
    check_fresh(deletes, data.annotations)
    left = data.annotations.join(deletes.select("ann_id"), "ann_id", "left_anti")
    images = D.ensure_image(data.images, name, width, height)
    image = images.where(F.regexp_extract("file_name", r"[^/\\]*$", 0) == name).agg(F.min("id")).first()[0]
    unknown = sorted(r[0] for r in new.select(F.col("category").alias("name")).distinct().join(data.categories.select("name"), "name", "left_anti").collect())  # label names of one request
    categories = D.add_labels(data.categories, unknown) if unknown else data.categories
    ids = categories.groupBy(F.col("name").alias("category")).agg(F.min("id").alias("category_id"))
    rows = new.join(F.broadcast(ids), "category").withColumn("image_id", F.lit(image).cast("long"))
    columns = [c for c in left.columns if c in (*rows.columns, "ann_id")]
    table = left.select(*columns).withColumnRenamed("ann_id", "id")
    merged = D.append_rows(table, rows.select(*[c for c in columns if c != "ann_id"], "order"), ["order"]).drop("order").withColumnRenamed("id", "ann_id")
    return Dataset(images, categories, merged), {"new": rows.count(), "deleted": data.annotations.count() - left.count()}


def edit_labels(data: Dataset, action: str, labels: Sequence[str], target: str = "") -> tuple[Dataset, int]:
    """One label edit: add, drop, merge (into ``target``) or parent (under ``target``); also how many annotations it removed."""
    if action == "add":
        return Dataset(data.images, D.add_labels(data.categories, labels), data.annotations), 0
    if action == "drop":
        categories, annotations = D.drop_labels(data.categories, data.annotations, labels)
        return Dataset(data.images, categories, annotations), data.annotations.count() - annotations.count()
    if action == "merge":
        categories, annotations = D.merge_labels(data.categories, data.annotations, labels, target)
        return Dataset(data.images, categories, annotations), 0
    if action == "parent":
        categories = data.categories
        for name in labels:
            categories = D.set_parent(categories, name, target)
        return Dataset(data.images, categories, data.annotations), 0
    raise ValueError(f"no such edit: {action!r}")


def replace_rows(table: DataFrame, changed: DataFrame, key: str = "ann_id") -> DataFrame:
    """The table with changed rows in place of those of equal keys; rows of other keys are not added."""
    held = changed.join(table.select(key), key, "left_semi")
    return table.join(held.select(key), key, "left_anti").unionByName(held.select(*table.columns))


def request(pending: DataFrame, saved: DataFrame) -> DataFrame:
    """(image_id, n_new, n_deletes, n_unsaved): what a save sends — ticked pending rows and saved rows staged for deletion; unticked ones are left out."""
    sent = pending.groupBy("image_id").agg(F.count_if("ticked").alias("n_new"), F.count_if(~F.col("ticked")).alias("n_unsaved"))
    staged = saved.groupBy("image_id").agg(F.count_if("staged").alias("n_deletes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sent.join(staged, "image_id", "full").select("image_id", zero("n_new"), zero("n_deletes"), zero("n_unsaved"))


def merge_pending(groups: DataFrame) -> DataFrame:
    """Pending instances after grouping with the saved ones: groups with a saved member drop theirs, others become one of their best score.

    ``groups``: image_id, seed, ann_id, saved, score, box.
    """
    bounds = [f(c).alias(c) for c, f in zip(("x0", "y0", "x1", "y1"), (F.min, F.min, F.max, F.max), strict=True)]
    out = groups.groupBy("image_id", "seed").agg(F.bool_or("saved").alias("anchored"), F.count("*").alias("members"), F.max("score").alias("score"), *bounds)
    return out.where("NOT anchored").drop("anchored")


# ------------------------------------------------------------- search index


def fingerprint_status(index: DataFrame, files: DataFrame, digest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(name, status) per file: valid (size and time as indexed), revalidated (size and content), invalid or missing.

    ``digest`` turns the files whose time has changed into (name, sha256); only those
    are read.  Without it ``files`` holds their sha256 already.
    """
    known = index.select("name", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.col("sha256").alias("_sha256"), F.lit(True).alias("_known"))
    both = files.join(known, "name", "left")
    same_size = F.col("size") == F.col("_size")
    valid = same_size & (F.col("modified") == F.col("_modified"))
    if digest is not None:
        doubtful = both.where(F.col("_known") & same_size & ~valid).select(*files.columns)
        both = both.drop("sha256").join(digest(doubtful), "name", "left")
    status = F.when(F.col("_known").isNull(), "missing").when(valid, "valid").when(same_size & (F.col("sha256") == F.col("_sha256")), "revalidated").otherwise("invalid")
    return both.select("name", status.alias("status"))


def content_digest(paths: DataFrame, spark: SparkSession) -> DataFrame:
    """(name, sha256) of listed files (path, name), read by the executors."""
    found = [r["path"] for r in paths.select("path").collect()]  # names of one directory's changed files
    if not found:
        return spark.createDataFrame([], "name string, sha256 string")
    read = spark.read.format("binaryFile").load(found)
    return read.select(F.regexp_extract("path", r"[^/]*$", 0).alias("name"), F.sha2("content", 256).alias("sha256"))


def upsert_searches(index: DataFrame, records: DataFrame, status: DataFrame) -> DataFrame:
    """Search records after an upsert by (name, prompt): an image whose index is missing or invalid starts anew.

    Columns: name, prompt, position, width, height and what a search found.  A record's
    size is the image's, and also overwrites that of its older searches.
    """
    usable = status.where(F.col("status").isin("valid", "revalidated")).select("name")
    kept = index.join(usable, "name", "left_semi")
    merged = D.upsert(kept, records, ["name", "prompt"])
    size = records.groupBy("name").agg(F.max_by("width", "position").alias("_w"), F.max_by("height", "position").alias("_h"))
    out = merged.join(size, "name", "left")
    return out.withColumn("width", F.coalesce("_w", "width")).withColumn("height", F.coalesce("_h", "height")).drop("_w", "_h")


def write_searches(searches: DataFrame, directory: str) -> None:
    """One versioned document per image, each written beside its place and moved there."""
    spark = searches.sparkSession
    rest = [c for c in searches.columns if c not in ("name", "position")]
    docs = searches.groupBy("name").agg(F.to_json(F.struct(F.lit(INDEX_VERSION).alias("version"), F.array_sort(F.collect_list(F.struct("position", *rest))).alias("searches"))).alias("body"))
    for name, body in docs.toLocalIterator():  # a document per image of one directory
        write_atomic(spark, f"{directory}/{name}.json", body)


class FileStore:
    """A table read from a file once, and again when the file's size or time has changed."""

    def __init__(self, spark: SparkSession, read: Callable[[str], object]):
        self.spark, self.read, self.held = spark, read, {}

    def signature(self, path: str) -> tuple[int, int]:
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found = jvm.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jvm)
        return found.getLen(), found.getModificationTime()

    def get(self, path: str) -> object:
        mark = self.signature(path)
        if self.held.get(path, (None,))[0] != mark:
            self.held[path] = (mark, self.read(path))
        return self.held[path][1]


def drifted(a: str, b: str, limit: float = 1.0) -> Column:
    return F.greatest(*[F.abs(F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in ("x0", "y0", "x1", "y1")]) > limit
