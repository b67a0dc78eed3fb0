"""Files, directories and messages as tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.operators.review import listed_name
from tilewright.sources.coco import IMAGE_SUFFIXES, MASK_NAME

#: Exif orientations whose width and height are swapped in the upright frame.
TURNED = (5, 6, 7, 8)


def empty_dataset(spark: SparkSession) -> dict[str, DataFrame]:
    """The three tables of a dataset without rows."""
    schemas = {
        "images": "id long, file_name string, width int, height int",
        "categories": "id long, name string, supercategory string",
        "annotations": "id long, image_id long, category_id long, segmentation string, bbox array<double>, area double, iscrowd int, score double",
    }
    return {k: spark.createDataFrame([], s) for k, s in schemas.items()}


# ------------------------------------------------------------- image sizes


def png_size(data: bytes) -> tuple[int, int] | None:
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR" or len(data) < 24:
        return None
    return struct.unpack(">II", data[16:24])


def _exif_orientation(segment: bytes) -> int:
    """Tag 0x0112 of the first directory of an Exif segment, 1 without it."""
    if segment[:6] != b"Exif\0\0" or len(segment) < 14:
        return 1
    body = segment[6:]
    order = {b"II": "<", b"MM": ">"}.get(body[:2])
    if order is None:
        return 1
    at = struct.unpack(order + "I", body[4:8])[0]
    if at + 2 > len(body):
        return 1
    for k in range(struct.unpack(order + "H", body[at : at + 2])[0]):
        entry = body[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
            return struct.unpack(order + "H", entry[8:10])[0]
    return 1


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Size of a JPEG in its upright frame, from its frame header and Exif orientation."""
    if data[:2] != b"\xff\xd8":
        return None
    at, orientation = 2, 1
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if mark == 0xE1:
            orientation = _exif_orientation(data[at + 4 : at + 2 + length])
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            if at + 9 > len(data):
                return None
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return (h, w) if orientation in TURNED else (w, h)
        at += 2 + length
    return None


def image_sizes(spark: SparkSession, directory: str) -> DataFrame:
    """(name, width, height) of PNG and JPEG files in their upright frame; null for other or broken files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [png_size(bytes(d)) or jpeg_size(bytes(d)) or (None, None) for d in batch["content"]]
            yield pd.DataFrame({"name": batch["path"].str.rsplit("/", n=1).str[-1], "width": pd.array([s[0] for s in sizes], "Int32"), "height": pd.array([s[1] for s in sizes], "Int32")})

    return spark.read.format("binaryFile").load(directory).select("path", "content").mapInPandas(run, "name string, width int, height int")


# ------------------------------------------------------------- directories


def directory_entries(listing: DataFrame, wanted: str | None = None) -> DataFrame:
    """Entries of a listing (name, is_directory): kind directory, image or mask, by lower-case name, with their position in their kind.

    Names that begin with a dot and other files go.  ``is_wanted`` marks the image that
    equals ``wanted`` but for case and trailing dots and spaces.
    """
    ending = F.lower(F.regexp_extract("name", r"\.[^.]*$", 0))
    kind = F.when(F.col("is_directory"), "directory").when(ending.isin(list(IMAGE_SUFFIXES)), F.when(F.col("name").rlike(MASK_NAME), "mask").otherwise("image"))
    kept = listing.where(~F.col("name").startswith(".")).withColumn("kind", kind).where("kind IS NOT NULL")
    at = F.row_number().over(W.partitionBy("kind").orderBy(F.lower("name"), "name")) - 1  # a row per entry of one directory
    same = F.lit(False) if wanted is None else (F.col("kind") == "image") & (listed_name(F.col("name")) == listed_name(F.lit(wanted)))
    return kept.select("kind", "name", at.cast("long").alias("position"), same.alias("is_wanted"))


def first_existing(spark: SparkSession, base: str, names: Sequence[str]) -> str | None:
    """The first of several relative names that exists below a folder."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        place = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        if place.getFileSystem(conf).exists(place):
            return f"{base}/{name}"
    return None


def resolve_path(root: str, raw: str) -> str:
    """A request's path under a root; ValueError for one that is blank or leaves the root."""
    parts: list[str] = []
    for part in raw.strip().replace("\\", "/").split("/"):
        if part == "..":
            if not parts:
                raise ValueError(f"outside of the root: {raw!r}")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    if not parts:
        raise ValueError("blank path")
    return "/".join([root.rstrip("/"), *parts])


def source_keys(spark: SparkSession, directory: str) -> DataFrame:
    """(name, key): path and modification time of every file."""
    files = spark.read.format("binaryFile").load(directory).select("path", "modificationTime")
    return files.select(F.regexp_extract("path", r"[^/]*$", 0).alias("name"), F.concat_ws(":", "path", F.unix_millis("modificationTime").cast("string")).alias("key"))


def file_hashes(spark: SparkSession, directory: str) -> DataFrame:
    """(name, sha256, short): digest of every file's content, and the first 16 digits of its path's SHA-1."""
    files = spark.read.format("binaryFile").load(directory)
    return files.select(F.regexp_extract("path", r"[^/]*$", 0).alias("name"), F.sha2("content", 256).alias("sha256"), F.substring(F.sha1("path"), 1, 16).alias("short"))


def utc_now() -> Column:
    """The current time to the second, in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def data_url(content: Column, mime: str) -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))


# ------------------------------------------------------------- messages


def parse_lines(text: DataFrame, schema: str) -> DataFrame:
    """Events of newline-delimited JSON (stream, chunk, value): chunks of a stream join in order, a line may cross them.

    Blank and broken lines go.  A stream's chunks are one row, as a response is.
    """
    whole = text.groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "value"))), lambda c: c["value"]), "").alias("body"))
    lines = whole.select("stream", F.posexplode(F.split("body", "\n")).alias("line", "value")).where("trim(value) <> ''")
    parsed = lines.select("stream", "line", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("e"))
    return parsed.where("e IS NOT NULL AND e._bad IS NULL").select("stream", F.col("line").cast("long").alias("line"), "e.*").drop("_bad")


def parse_history(stored: DataFrame) -> DataFrame:
    """(user_id, prompts) of stored histories: JSON arrays of strings, or empty where they cannot be read."""
    none = F.array().cast("array<string>")
    return stored.select("user_id", F.coalesce(F.from_json("stored", "array<string>"), none).alias("prompts"))


def event_lines(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """(seq, line): one JSON line per event in order; fields without value are left out."""
    return events.orderBy(*order).select("seq", F.to_json(F.struct(*events.columns)).alias("line"))


def append_spill(entries: DataFrame, path: str) -> None:
    """Append cache entries to their table, a folder per source and grid; committed files never change."""
    entries.write.mode("append").partitionBy("source_key", "grid_key").parquet(path)


def spill_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source_key, grid_key, entries, bytes) of a spill table."""
    return spark.read.parquet(path).groupBy("source_key", "grid_key").agg(F.count("*").alias("entries"), F.sum(F.octet_length("payload")).alias("bytes"))


def split_planes(values: bytes) -> tuple[bytes, bytes]:
    """High and low bytes of 16-bit little-endian values apart: the high ones compress well."""
    return values[1::2], values[0::2]


def join_planes(high: bytes, low: bytes) -> bytes:
    out = bytearray(2 * len(high))
    out[1::2], out[0::2] = high, low
    return bytes(out)
