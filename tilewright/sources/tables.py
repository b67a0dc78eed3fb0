"""Hand-over tables between the steps of an operator, and atomic files, in any store that Spark reaches."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder; only a local session may lack that and use a temporary one."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    base = held.get() if not held.isEmpty() else spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="tilewright-")
        context.setCheckpointDir(base)
        base = context._jsc.sc().getCheckpointDir().get()
    return f"{base}/{uuid.uuid4().hex}"


_gathered: dict[str, float] = {}


def give_back(spark: SparkSession, every: float = 2.0) -> None:
    """Have the driver collect its garbage now: plans, compiled code and heap of the steps before go, and with them their shuffle files.

    Spark removes the shuffle files of a finished step only once the driver happens to
    collect what refers to them; until then a chain of steps holds the disk of all.
    Steps within ``every`` seconds of the last call wrote little and are left for the next.
    """
    name, now = spark.sparkContext.applicationId, time.monotonic()
    if now - _gathered.get(name, 0.0) >= every:
        gc.collect()  # what Python still holds, the driver's Java side keeps
        spark._jvm.System.gc()
        trim(spark)
        _gathered[name] = time.monotonic()


def trim(spark: SparkSession) -> str:
    """Have the driver's C library return to the system what the JVM has freed outside its heap; '' where the JVM cannot.

    Compiling and planning many steps leaves arenas of freed memory, which no collection
    of the heap returns.
    """
    java, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        of = java.java.lang.Class.forName
        call = gateway.new_array(java.java.lang.Object, 4)
        call[0] = java.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        call[1] = "systemTrimNativeHeap"
        call[2], call[3] = gateway.new_array(java.java.lang.Object, 1), gateway.new_array(java.java.lang.String, 1)
        call[2][0], call[3][0] = gateway.new_array(java.java.lang.String, 0), "[Ljava.lang.String;"
        types = gateway.new_array(java.java.lang.Class, 4)
        types[0], types[1], types[2], types[3] = call[0].getClass(), of("java.lang.String"), call[2].getClass(), call[3].getClass()
        server = java.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return str(of("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, call))
    except Py4JError:
        return ""


def hand_over(rows: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a written table: later steps read it, and lost executors repeat none of the steps before."""
    path = f"{shared_folder(rows.sparkSession)}/{name}"
    rows.write.parquet(path)
    done = rows.sparkSession.read.parquet(path)
    give_back(rows.sparkSession)  # after the read: until some later job, Spark's listeners hold the plan of the write
    return done


def write_atomic(spark: SparkSession, path: str, body: str) -> None:
    """Write a text file beside its place and move it there, so that readers see the old file or the whole new one."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{uuid.uuid4().hex}.tmp")
    files = place.getFileSystem(conf)
    out = files.create(beside, True)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(beside, place, options)
