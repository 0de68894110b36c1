"""Tables in the shared folder: lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@functools.cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="lexiweave-")
    atexit.register(shutil.rmtree, path, True)
    return "file://" + path


@functools.cache
def _run_dir(application: str, shared: str) -> str:
    """A folder of this driver's own within the shared one; it goes when the driver ends."""
    path = f"{shared}/lexiweave-{application}-{uuid.uuid4().hex[:8]}"

    def gone() -> None:
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None:
            delete_path(spark, path)

    atexit.register(gone)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset (tests on one machine) a temporary one. The
    session's settings are read and not changed."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return _run_dir(spark.sparkContext.applicationId, named.rstrip("/")) if named else _local_dir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: df written to the shared folder and read back, so that it is computed once however often it is
    read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete kept tables that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_kept_at", None):
            delete_path(t.sparkSession, path)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A scan with a task for each core at least: files of few row groups are dealt out before the work on their texts,
    and larger tables, which have tasks enough, are left where they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if scan._jdf.rdd().getNumPartitions() < cores else scan
