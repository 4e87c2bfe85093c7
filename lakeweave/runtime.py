"""Session helpers shared by every operator: table reading, durable cut points and size checks."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes the shuffle files of an execution when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A side is only hinted for broadcast when its measured row count is at most this.
BROADCAST_ROWS = 100_000


def local_session(name: str = "lakeweave", cores: int = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One input table; Parquet column pruning and filters reach this scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. It is ``spark.checkpoint.dir``; only where that is unset
    (tests, local runs) a temporary folder of this machine is taken and registered."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lakeweave-"))
        current = context.getCheckpointDir()
    return current


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone at interpreter exit
        pass


#: Folders written by ``settle`` and not yet released.
SETTLED: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete all that ``settle`` wrote so far, once the results that read it are written or shown;
    returns the number of folders. A long session calls it after each query."""
    n = len(SETTLED)
    while SETTLED:
        _remove(spark, SETTLED.pop())
    return n


def settle(df: DataFrame, partition_by: list[str] | None = None, rows_per_file: int = 0) -> DataFrame:
    """Cut the lineage: write the rows as Parquet into the shared folder and read them back.

    Lost executors then cost a re-read, never a recomputation of the whole plan. The files are
    removed by ``release``, at the latest when the driver process ends. What the write shuffled is never
    read again, so these files go with it.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"settled-{uuid.uuid4().hex}")
    writer = df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    if not SETTLED:
        atexit.register(release, spark)
    SETTLED.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete settled frames that nothing unevaluated reads any more."""
    for df in frames:
        _remove(df.sparkSession, df.settled)
        SETTLED.remove(df.settled)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only when the side was counted and is under ``BROADCAST_ROWS``; a larger
    side is left to the shuffle join that adaptive execution picks and splits where skewed."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not use yet (inputs may carry clashing extra columns)."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = "_" + name
    return name
