"""Input tables of the registered queries (driver parquet, read lazily)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["documents", "pages", "labels", "embeddings", "conversations", "benchmark"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of a driver table, spread over the cores when the file has too few splits."""
    from sift.session import ensure_parallel
    return ensure_parallel(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def cluster_of_source(c="source"):
    """Stand-in cluster id: 'src17' -> 17."""
    return F.substring(F.col(c), 4, 100).cast("int")
