"""Session settings and the size checks that guard every broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest input, in bytes at the scan, that may be broadcast.
BROADCAST_LIMIT = 64 << 20

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join keyed by (series, issue date) may use rows already placed by series.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the Python call site of every expression doubles the time to build a wide plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "fluxloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings. On a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def input_bytes(df: DataFrame) -> int:
    """Size of everything the plan scans, from Catalyst's leaf statistics. Runs no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def fits(df: DataFrame, limit: int) -> bool:
    """True when the plan's input is known to be at most ``limit`` bytes."""
    # Without a JVM plan (Spark Connect) the size is unknown: treat the input as large.
    return hasattr(df, "_jdf") and input_bytes(df) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only when the input size is checked; beyond it the join shuffles."""
    return F.broadcast(df) if fits(df, limit) else df


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables.

    Only a session in one process may do without: it gets a temporary folder. Elsewhere a folder of
    the driver's machine would not be seen by the executors, so a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="fluxloom-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/fluxloom-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and read it back, where several branches of a plan would recompute it.

    The table survives lost executors, cuts the lineage, and gives Catalyst true sizes, so joins
    downstream choose their strategy by fact.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Remove every table that ``staged`` wrote in this session's folder; call it when a run is over."""
    jvm, folder = spark._jvm, shared_folder(spark)
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "fluxloom-*")) or []:
        fs.delete(found.getPath(), True)
