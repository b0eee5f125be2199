"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that go to Python at once. A batch is held several times over, in the JVM and in the worker, by every running task.
BATCH_BYTES = 4 << 20


def build_session(app_name: str = "mediacast", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators rely on; a cluster's own values win when given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_folder(spark: SparkSession) -> str:
    """The shared folder for staged tables: the session's checkpoint folder, a scratch one only in local mode."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="mediacast-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in whose session Python functions get their rows about ``BATCH_BYTES`` at a time; a longer row stands alone.

    Spark's own bound is 10,000 rows or 64 MB, which for texts is tens of megabytes. The setting holds for the session from here on,
    as plans are made when they run; a value that the session already has stays.
    """
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs in here go when it ends, not when the driver collects its garbage.

    A value that the session already has stays.
    """
    if spark.conf.get(CLEANUP_SETTING, None) is not None:
        yield
        return
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_SETTING)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage behind it, survives lost executors, prunes columns and pushes
    filters down, and has a real size, so that Spark broadcasts it only when it is small.
    Nothing reads the shuffle files of the write again, so they are dropped with it.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove the tables that ``stage`` wrote for ``df``, once nothing reads them any longer."""
    spark = df.sparkSession
    jvm, top = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(staging_folder(spark))
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in sorted({f.rpartition("/")[0] for f in df.inputFiles()}):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        if not fs.makeQualified(path).getParent().equals(fs.makeQualified(top)):
            raise ValueError(f"{folder} is not a staged table")
        fs.delete(path, True)
