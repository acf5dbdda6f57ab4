"""Incremental keyword frequencies over arriving comment files.

The original pipeline is batch only; this module runs the same cleaning
expressions and the same A1 aggregation on a Structured Streaming source, so
a directory that receives new comment files keeps its per-group token counts
current without recomputing old files.  State is the per-(group, token)
count held by Spark's state store (checkpointed, so it survives restarts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.functions import text as T

COMMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def comment_stream(spark: SparkSession, directory: str, schema: str = COMMENT_SCHEMA,
                   file_glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving in ``directory`` (optionally only names matching ``file_glob``)."""
    r = spark.readStream.schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(directory)


def keyword_counts(stream: DataFrame, group_col: str = "source", text_col: str = "text") -> DataFrame:
    """A1 on a stream: running ``cnt`` per ``(group, token)``."""
    toks = T.explode_nonempty(stream, [group_col], T.keyword_tokens(text_col), "token")
    return toks.groupBy(group_col, "token").agg(F.count(F.lit(1)).alias("cnt"))


def start_keyword_counts(stream: DataFrame, sink_path: str, checkpoint: str, group_col: str = "source"):
    """Write each micro-batch's updated counts to ``sink_path/batch_id=<id>``.

    A batch that runs again after a failure overwrites its own folder, so no row
    comes twice; :func:`latest_counts` reads the current count of every token.
    """
    counts = keyword_counts(stream, group_col)

    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch_id={batch_id}")

    return (counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
                  .foreachBatch(write).start())


def latest_counts(spark: SparkSession, sink_path: str, group_col: str = "source") -> DataFrame:
    """The newest count of every ``(group, token)``."""
    rows = spark.read.option("basePath", sink_path).parquet(sink_path)
    return rows.groupBy(group_col, "token").agg(F.max_by("cnt", "batch_id").alias("cnt"))
