"""Sharding: a consistent-hash ring with virtual nodes and bounded loads (native).

The ring has ``CELLS`` positions.  Each shard owns ``virtual_nodes`` of them, placed
by hash; a row's position is the hash of its key and its first choice is the shard of
the next virtual node clockwise.  Every shard has a hard capacity.  Rows that a full
shard cannot take continue clockwise to the next virtual node of a shard that still
has room.  This runs in rounds over the shrinking overflow only; each round with an
overflow fills at least one shard, so there are at most as many rounds as shards.

Capacities are the exact fair shares (counts at most one apart, law ``rows``), which
is the bounded-load scheme at load factor one.

Scale: row numbers inside a shard come from a (shard, bucket) histogram of bounded
size plus row numbers inside one bucket, so no task sees a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.llm.common import settle, table

CELLS = 1 << 14


def ring(spark: SparkSession, shards: int, virtual_nodes: int, open_shards: list[int], seed: int) -> DataFrame:
    """Rows (cell, shard): for each ring cell, the open shard met next clockwise.  CELLS rows.

    A shard's nodes depend on its number and theirs alone, not on how many shards there are.
    """
    shard, node = F.floor(F.col("id") / virtual_nodes).cast("int"), (F.col("id") % virtual_nodes).cast("int")
    nodes = (
        spark.range(shards * virtual_nodes, numPartitions=1)
        .select(shard.alias("shard"), F.pmod(F.xxhash64(shard, node, F.lit(seed)), F.lit(CELLS)).alias("cell"))
        .where(F.col("shard").isin(open_shards))
    )
    twice = nodes.unionAll(nodes.select("shard", F.col("cell") + CELLS))
    spots = twice.groupBy("cell").agg(F.min("shard").alias("shard"))
    clockwise = W.orderBy(F.col("cell").desc()).rowsBetween(W.unboundedPreceding, 0)
    return (
        spark.range(2 * CELLS, numPartitions=1)
        .select(F.col("id").alias("cell"))
        .join(spots, "cell", "left")
        .select("cell", F.last("shard", ignorenulls=True).over(clockwise).alias("shard"))
        .where(F.col("cell") < CELLS)
    )


def ring_shards(
    rows: DataFrame,
    key: Column,
    shards: int = 16,
    virtual_nodes: int = 128,
    buckets: int = 1024,
    seed: int = 7,
) -> DataFrame:
    """``rows`` plus shard int and slot long (gapless from 0 in each shard).

    Nulls in the key hash like any value.  Equal keys and repeated rows are separate
    rows that keep their own slots.  An empty input gives an empty result.  Columns of
    the input named shard, slot or starting with _ring_ are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot", "_ring_cell", "_ring_turn", "_ring_bucket")
    names = rows.columns
    rest = settle(
        rows.withColumn("_ring_cell", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(CELLS)))
        .withColumn("_ring_turn", F.xxhash64(key, F.lit(seed + 1)))
        .withColumn("_ring_bucket", F.pmod("_ring_turn", F.lit(buckets)).cast("int"))
    )
    total = rest.count()
    room = {s: total // shards + (s < total % shards) for s in range(shards)}
    used = dict.fromkeys(room, 0)
    done = rest.limit(0).select(*names, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    while total:
        open_shards = [s for s in room if used[s] < room[s]]
        placed = rest.join(F.broadcast(ring(spark, shards, virtual_nodes, open_shards, seed)).withColumnRenamed("cell", "_ring_cell"), "_ring_cell")
        counts = settle(placed.groupBy("shard", "_ring_bucket").agg(F.count("*").alias("n")))  # at most shards * buckets rows
        asked = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        earlier = W.partitionBy("shard").orderBy("_ring_bucket").rowsBetween(W.unboundedPreceding, -1)
        starts = counts.select("shard", "_ring_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
        inside = W.partitionBy("shard", "_ring_bucket").orderBy("_ring_turn", *names)
        limits = F.create_map(*[F.lit(x).cast("long") for s in room for x in (s, room[s] - used[s])])
        offset = F.create_map(*[F.lit(x).cast("long") for s in room for x in (s, used[s])])
        ranked = settle(
            placed.withColumn("_in", F.row_number().over(inside))
            .join(F.broadcast(starts), ["shard", "_ring_bucket"])
            .withColumn("_rank", F.col("start") + F.col("_in") - 1)
            .withColumn("_fits", F.col("_rank") < limits[F.col("shard").cast("long")])
            .withColumn("slot", F.col("_rank") + offset[F.col("shard").cast("long")])
        )
        done = done.unionAll(ranked.where("_fits").select(*names, "shard", "slot"))
        left = sum(max(0, n - (room[s] - used[s])) for s, n in asked.items())
        for s, n in asked.items():
            used[s] = min(room[s], used[s] + n)
        rest = ranked.where("not _fits").select(*names, "_ring_cell", "_ring_turn", "_ring_bucket")
        total = left
    return done


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document with size, text checksum, shard and slot; equal texts are not kept together.

    A null or empty text has size 1 and the checksum of no bytes.  Rows take their place on
    the ring by id, size and checksum, so rows without an id, or that share one, spread as
    others do.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return ring_shards(rows, F.xxhash64("doc_id", "size", "text_crc32"), shards)


def op4_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
