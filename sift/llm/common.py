"""Helpers of the training-data operators: table scans, shared folder, size checks."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sift.session import BATCH_BYTES, bounded_batches, checkpoint_dir, cut_lineage, importable  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of an input table; a table of fewer splits than cores is dealt out to all cores."""
    bounded_batches(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return dealt(df)


def dealt(df: DataFrame) -> DataFrame:
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: it keeps its free memory
        return None


def tidy(run):
    """A map over Arrow batches that hands freed memory back when its task ends (workers live on)."""
    @functools.wraps(run)
    def mapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if _libc() is not None and hasattr(_libc(), "malloc_trim"):
                _libc().malloc_trim(0)
    return mapped


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's checkpoint folder, which all machines share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """The file path of a shared folder that every machine mounts (file: or no scheme)."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped files need a checkpoint folder mounted on all machines, not {path}")
    return path


def drop_finished(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished jobs now: it follows the driver's
    garbage collections, which may be far apart."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read back: a checkpoint in compressed columns."""
    spark, schema = df.sparkSession, df.schema
    path = shared_path(spark, name)
    df.write.parquet(path)
    del df
    drop_finished(spark)
    return spark.read.schema(schema).parquet(path)
