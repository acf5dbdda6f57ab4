"""Sinks (K1-K12) and the content-keyed embedding cache (S10 + K4)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def output_path(base: str, now: datetime | None = None) -> str:
    """K3 + X1: ``<base>/output-YYYY-mm-dd-HH-MM-SS`` (directory created by the first write)."""
    now = now or datetime.now(timezone.utc)
    return f"{base.rstrip('/')}/output-{now.strftime('%Y-%m-%d-%H-%M-%S')}"


def flatten_arrays(df: DataFrame, sep: str = " ") -> DataFrame:
    """Arrays rendered as strings so the frame fits a flat CSV."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, ArrayType):
            cols.append(F.array_join(F.col(f.name).cast("array<string>"), sep).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_annotated(df: DataFrame, path: str, csv: bool = False) -> None:
    """K1: annotated comments as Parquet (arrays kept), optionally a flat CSV next to it."""
    df.write.mode("overwrite").parquet(f"{path}/data.parquet")
    if csv:
        flatten_arrays(df).write.mode("overwrite").option("header", True).csv(f"{path}/data.csv")


def write_clusters(df: DataFrame, path: str) -> None:
    """K2: one JSON row per cluster (cluster, keywords, label, sentences)."""
    df.write.mode("overwrite").json(f"{path}/clusters.json")


def write_changed_pairs(df: DataFrame, path: str) -> None:
    """K8: tab-separated (original, corrected) rows."""
    df.select("original", "corrected").write.mode("overwrite").option("sep", "\t").csv(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """K9: (comment, label) CSV without an index column."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_stage(df: DataFrame, base: str, stage: int) -> None:
    """One Parquet table per pipeline stage, array columns kept."""
    df.write.mode("overwrite").parquet(f"{base}/stage{stage}.parquet")


def write_keywords_by_question(df: DataFrame, path: str, question_col: str = "question_text") -> None:
    """Keyword table partitioned by question."""
    df.write.mode("overwrite").partitionBy(question_col).parquet(path)


def append_runs(runs: DataFrame, path: str) -> None:
    """K5 + K6: append run rows (one or many) to the run table, partitioned by grid id.
    Write errors propagate."""
    runs.write.mode("append").partitionBy("grid_id").parquet(path)


def path_exists(spark, path: str) -> bool:
    """Whether a path exists in its file system (errors of the store propagate)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete_grid(spark, path: str, grid_id: int) -> None:
    """K7: drop one grid id = remove its partition directory of the run table."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/grid_id={int(grid_id)}")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (vocabulary and weights included)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def cached_embeddings(df: DataFrame, text_col: str, embed: Callable[[DataFrame], DataFrame],
                      cache_path: str, key_col: str = "text_key") -> DataFrame:
    """S10 + K4: embeddings keyed by a content hash of the text.

    Rows whose key is in the Parquet cache reuse the stored vector; only the
    misses go through ``embed`` (a DataFrame -> DataFrame transform adding
    ``embedding``) and are appended to the cache.  A null text has a key of its
    own, so every input row comes back; a row that ``embed`` leaves out has a null
    vector.  The cache counts as empty only if its path does not exist.
    """
    spark = df.sparkSession
    key = F.coalesce(F.sha2(F.col(text_col), 256), F.lit("null"))
    keyed = df.withColumn(key_col, key)
    misses = keyed
    if path_exists(spark, cache_path):
        misses = keyed.join(spark.read.parquet(cache_path).select(key_col), key_col, "left_anti")
    embed(misses).select(key_col, "embedding").dropDuplicates([key_col]) \
        .write.mode("append").parquet(cache_path)
    cache = spark.read.parquet(cache_path).groupBy(key_col).agg(F.min("embedding").alias("embedding"))
    return keyed.join(cache, key_col, "left")
