"""Session helpers of the corpus operators: tables, checkpoints, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.sources.tables import give_back

#: Java regular expression of one separator run; its complement is a word.
SEPARATOR_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this session, which all executors share.

    It comes from ``spark.checkpoint.dir``.  Only a local session, as in tests, may
    lack that; it then gets a temporary folder.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
            named = tempfile.mkdtemp(prefix="tilewright-checkpoint-")
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


#: Tables that stash has written, by application: release() removes them.
_written: dict[str, list[str]] = {}


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder.

    What is read back has the statistics of its files: sizes estimated over many rounds
    of joins would grow without bound, as those of a checkpoint do.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    done = spark.read.parquet(path)
    give_back(spark)  # after the read: until some later job, Spark's listeners hold the plan of the write
    return done


def written(spark: SparkSession) -> int:
    """How many stashed tables this application holds: a mark for release()."""
    return len(_written.get(spark.sparkContext.applicationId, ()))


def release(spark: SparkSession, first: int, last: int) -> None:
    """Remove the stashed tables written from mark ``first`` to mark ``last``; nothing that is still to be read may come from them."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths[first:last]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    del paths[first:last]


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a step."""
    return stash(df, "step")


ROWS_IN_PARTITION = 100_000


def settle_narrow(df: DataFrame) -> DataFrame:
    """A step's table in as few partitions as its counted rows need: small tables then join and group without shuffles."""
    done = settle(df)
    return done.coalesce(max(1, ceil(done.count() / ROWS_IN_PARTITION)))


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts as no text."""
    parts = F.split(F.coalesce(text, F.lit("")), SEPARATOR_RUN)
    edges = (F.element_at(parts, 1) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - edges).cast("long")


def unit_hash(seed: int, *columns: str | Column) -> Column:
    """Reproducible value in [0, 1) from the columns' 64-bit hash (its top 52 bits)."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 12) / F.lit(float(1 << 52))


FOREST_EDGES = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges replaced by stars around each component's smallest node, FOREST_EDGES at a time."""

    def stars(root: dict[int, int]) -> pa.RecordBatch:
        pairs = [(top(root, x), x) for x in root]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

    def top(root: dict[int, int], x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    root: dict[int, int] = {}
    held = 0
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(root, root.setdefault(x, x)), top(root, root.setdefault(y, y))
            root[max(a, b)] = min(a, b)
        held += len(batch)
        if held >= FOREST_EDGES:
            yield stars(root)
            root, held = {}, 0
    yield stars(root)


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table of long ids: rows (node, label), label the smallest node.

    Edges first shrink to stars inside every partition.  Then each round hooks every
    node to its smallest neighbour, jumps along the hooks to their roots and contracts
    the edges to distinct pairs of different roots, which at least halves the nodes.
    Minima are combined before shuffles, joins are equi-joins that skew handling can
    split, and every round is written, so that statistics start anew.
    """
    shrink = lambda e: settle_narrow(e.where("u < v").distinct().mapInArrow(_forest, "u long, v long"))
    pairs = shrink(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")))
    pairs = shrink(pairs)  # once more over the narrower table, where few partitions hold all stars
    labels = None
    for _ in range(max_rounds):
        if labels is not None and pairs.isEmpty():
            return labels
        hooks = settle(pairs.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "node"))
        while True:  # hooks point to smaller nodes: forests, whose depth each pass halves
            ahead = hooks.select(F.col("node").alias("root"), F.col("root").alias("further"))
            moved = settle(hooks.join(ahead, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
            hooks = moved.select("node", "root")
            if moved.where("moved").isEmpty():
                break
        roots = hooks.withColumnRenamed("root", "to")
        if labels is None:
            labels = hooks.unionAll(hooks.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "label")
        else:
            labels = labels.join(roots.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = settle_narrow(labels)
        left = pairs.join(roots.withColumnRenamed("node", "u"), "u", "left").select(F.coalesce("to", "u").alias("u"), "v")
        both = left.join(roots.withColumnRenamed("node", "v"), "v", "left").select("u", F.coalesce("to", "v").alias("v"))
        pairs = shrink(both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
