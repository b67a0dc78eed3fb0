"""Annotation documents and directories as tables, and the atomic document sink."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tilewright.operators.runs import checked_counts
from tilewright.sources.tables import write_atomic

SCHEMA = """images array<struct<id: bigint, file_name: string, width: int, height: int>>,
categories array<struct<id: bigint, name: string, supercategory: string>>,
annotations array<struct<id: bigint, image_id: bigint, category_id: bigint, segmentation: string, bbox: array<double>, area: double, iscrowd: int, score: double>>"""

#: File name endings listed as images.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tif", ".tiff", ".webp", ".dng", ".cr2", ".cr3", ".nef", ".arw", ".orf", ".raf", ".rw2", ".pef", ".srw")
MASK_NAME = r"(?i)_mask(ed)?\.[^.]+$"


def is_dataset(text: str) -> bool:
    try:
        found = json.loads(text)
    except ValueError:
        return False
    return isinstance(found, dict) and all(isinstance(found.get(k), list) for k in ("images", "annotations", "categories"))


def find_dataset(spark: SparkSession, directory: str) -> str | None:
    """First JSON file by name that holds the three lists; others are skipped."""
    files = spark.read.text(directory, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_path").alias("path"))
    held = [F.get_json_object("value", f"$.{k}").startswith("[") for k in ("images", "annotations", "categories")]
    return files.where(held[0] & held[1] & held[2]).agg(F.min("path")).first()[0]


def read_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables images, categories and annotations; ValueError for a malformed document.

    Annotations get ``rle`` (counts, height, width) and, for compressed masks, ``runs``:
    run lengths, background first.  Polygons stay JSON; both are null for them.
    """
    whole = spark.read.schema(SCHEMA + ", _bad string").json(path, multiLine=True, columnNameOfCorruptRecord="_bad")
    bad = whole.select(F.col("_bad").isNotNull() | F.col("images").isNull() | F.col("annotations").isNull() | F.col("categories").isNull()).collect()  # a row per document
    if not bad or any(r[0] for r in bad):
        raise ValueError(f"not an annotation dataset: {path}")
    out = {k: whole.select(F.posexplode(k).alias("ord", "row")).select("ord", "row.*") for k in ("images", "categories")}
    rows = whole.select(F.posexplode("annotations").alias("ord", "row")).select("ord", "row.*")
    counts = F.get_json_object("segmentation", "$.counts")
    size = F.from_json(F.get_json_object("segmentation", "$.size"), "array<int>")
    rle = F.when(counts.isNotNull() & ~counts.startswith("["), F.struct(counts.alias("counts"), size[0].alias("height"), size[1].alias("width")))
    out["annotations"] = with_runs(rows.withColumn("rle", rle))
    return out


def with_runs(annotations: DataFrame) -> DataFrame:
    """``runs``: the decoded run lengths of every compressed mask, checked against its size; ValueError for one that does not fit."""
    schema = StructType([*annotations.schema.fields, StructField("runs", ArrayType(LongType()))])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if r is None else checked_counts(r["counts"].encode(), r["height"], r["width"]) for r in batch.column("rle").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "runs"])

    return annotations.mapInArrow(decode, schema)


def write_document(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON document, written beside its place and moved there, in any store; meant for documents that fit a driver."""
    body = {k: [json.loads(r) for r, in t.orderBy("ord").select(F.to_json(F.struct(*[c for c in t.columns if c not in ("ord", "rle", "runs")]))).collect()] for k, t in tables.items()}
    for row in body.get("annotations", ()):
        if isinstance(row.get("segmentation"), str):
            row["segmentation"] = json.loads(row["segmentation"])
    write_atomic(next(iter(tables.values())).sparkSession, path, json.dumps(body))


def list_images(spark: SparkSession, directory: str, masks: bool = False) -> DataFrame:
    """(path, name, length, modified) of the directory's images, or of its exported masks; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(directory).select("path", F.regexp_extract("path", r"[^/]*$", 0).alias("name"), "length", F.col("modificationTime").alias("modified"))
    ending = F.lower(F.regexp_extract("name", r"\.[^.]*$", 0))
    return files.where(ending.isin(list(IMAGE_SUFFIXES)) & (F.col("name").rlike(MASK_NAME) == F.lit(masks))).orderBy(F.lower("name"), "name")


def read_searches(spark: SparkSession, directory: str, images: DataFrame, version: int = 3) -> DataFrame:
    """Per image its search document, null where it is missing or of another version."""
    docs = spark.read.schema("version int, image struct<size: bigint, sha256: string>, searches array<struct<prompt: string, completed: boolean, instances: int>>").json(directory, multiLine=True)
    named = docs.select("*", F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("name")).where(F.col("version") == version)
    return images.join(named, "name", "left")


def normalize_prompt(text):
    """Trimmed, lower case, single spaces."""
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def read_records(data: bytes) -> list[tuple[int, int, int, int]]:
    """(index, kind, offset, length) of framed records: int32, uint8, int64, little-endian, then the payload."""
    out, at = [], 0
    while at + 13 <= len(data):
        index, kind, n = int.from_bytes(data[at : at + 4], "little", signed=True), data[at + 4], int.from_bytes(data[at + 5 : at + 13], "little", signed=True)
        if n < 0 or at + 13 + n > len(data):
            break
        out.append((index, kind, at + 13, n))
        at += 13 + n
    return out


def scan_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Framed records of binary files, one row each; a torn last record is left out."""
    def run(batches):
        import pandas as pd

        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(path, *r) for r in read_records(bytes(data))], columns=["path", "index", "kind", "offset", "length"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, index int, kind int, offset long, length long")
