"""Delivering a sweep's events: ordered batches, terminal errors, saves and jobs over a directory."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.operators.review import canonical_params


def micro_batches(tiles: DataFrame, size: int = 8) -> DataFrame:
    """(image_id, tile, batch, place): tiles in order, ``size`` to a model run."""
    at = F.row_number().over(W.partitionBy("image_id").orderBy("tile")) - 1
    return tiles.select("image_id", "tile", F.floor(at / size).cast("long").alias("batch"), (at % size).cast("long").alias("place"))


def ordered_lines(events: DataFrame) -> DataFrame:
    """(image_id, seq, line): events as JSON.  Encoding runs in any order and on any executor; ``seq`` puts the lines in order."""
    body = F.to_json(F.struct(*[c for c in events.columns if c not in ("image_id", "seq")]))
    return events.select("image_id", "seq", body.alias("line"))


def with_failures(events: DataFrame, failures: DataFrame) -> DataFrame:
    """Events of every image up to its failure (image_id, seq, message), which ends them as an ``error``; no ``done`` follows one."""
    kept = events.join(failures.select("image_id", F.col("seq").alias("_until")), "image_id", "left").where("_until IS NULL OR seq < _until").drop("_until")
    ends = failures.select("image_id", "seq", F.lit("error").alias("type"), F.col("message").alias("origin"))
    return kept.unionByName(ends, allowMissingColumns=True)


def encode_stream(events: Iterator[dict], encode: Callable[[dict], str]) -> Iterator[str]:
    """Lines of a running computation; an exception, in it or in encoding, becomes a last ``error`` line after those before it."""
    try:
        for event in events:
            yield encode(event)
    except Exception as problem:  # noqa: BLE001 - the stream's reader must learn of any failure
        yield encode({"type": "error", "message": str(problem)})


def not_done(queue: DataFrame, searches: DataFrame) -> DataFrame:
    """Queued searches (image_id, prompt, params) that are not complete with equal parameters."""
    done = searches.where("completed").select("image_id", "prompt", canonical_params(F.col("params")).alias("_key")).distinct()
    return queue.withColumn("_key", canonical_params(F.col("params"))).join(done, ["image_id", "prompt", "_key"], "left_anti").drop("_key")


def latest_request(requests: DataFrame) -> DataFrame:
    """Of requests (client, token, image_id) the newest of every client; earlier ones are out of date."""
    return requests.groupBy("client").agg(F.max_by("image_id", "token").alias("image_id"), F.max("token").alias("token"))


def commit_plan(records: DataFrame) -> DataFrame:
    """(image_id, prompt, kept, commit): searches without results are recorded at once, others with their image's save."""
    return records.select("image_id", "prompt", "kept", F.when(F.col("kept") == 0, "now").otherwise("with_save").alias("commit"))


def pending_after(records: DataFrame, saved: DataFrame, failed: DataFrame) -> DataFrame:
    """Records that are still to be written after a round: those of images not saved yet, and those whose write failed."""
    waiting = records.join(saved, "image_id", "left_anti").where("kept > 0")
    again = records.join(failed, ["image_id", "prompt"], "left_semi")
    return waiting.unionByName(again).distinct()


def directory_job(spark: SparkSession, folder: str, schema: str, process: Callable[[DataFrame, int], None], checkpoint: str, files_at_once: int = 8):
    """Process the files of a directory that are new since the last run, some at a time, and stop.

    The queue of a run is what the directory holds when it starts.  Stopping the returned
    query pauses the job; another run with the same checkpoint resumes it, and repeats
    at most the batch that was not finished.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return rows.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ------------------------------------------------------------- a client's state


def stash_pending(stored: DataFrame, image: int, pending: DataFrame) -> DataFrame:
    """Pending work per image, with that of one image put in place of what it had."""
    return stored.where(F.col("image_id") != image).unionByName(pending.where(F.col("image_id") == image))


def begin_redo(rows: DataFrame, label: str) -> DataFrame:
    """A label's instances before it is searched again: pending ones drop, saved ones are staged for deletion."""
    own = F.col("category") == label
    return rows.withColumn("state", F.when(own & (F.col("state") == "pending"), "dropped").when(own & (F.col("state") == "saved"), "staged").otherwise(F.col("state")))


def end_redo(before: DataFrame, during: DataFrame, found: DataFrame, outcome: str) -> DataFrame:
    """The instances after a redo: on ``done`` the new ones are pending beside what was kept, otherwise all is as before."""
    if outcome != "done":
        return before
    return during.where("state <> 'dropped'").unionByName(found.withColumn("state", F.lit("pending")))


def refine_requests(boxes: DataFrame) -> DataFrame:
    """(image_id, category, boxes): one request per label with all its queued boxes, in the order drawn."""
    box = F.struct("seq", "x0", "y0", "x1", "y1")
    return boxes.groupBy("image_id", "category").agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def refine(rows: DataFrame, boxes: DataFrame, found: DataFrame, keys: Sequence[str] = ("image_id", "category")) -> DataFrame:
    """Instances after a refinement: those centred in a queued box of their label go, the detections for it come."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    rects = boxes.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    hit = rows.join(rects, list(keys)).where(cx.between(F.col("b_x0"), F.col("b_x1")) & cy.between(F.col("b_y0"), F.col("b_y1"))).select("ann_id").distinct()
    return rows.join(hit, "ann_id", "left_anti").unionByName(found.select(*rows.columns))
