"""Scans (S1-S13): every input shape the original pipeline reads, as Spark readers.

All readers take explicit schemas or header names (no schema inference on
large inputs) and return DataFrames; nothing is read on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: column names of the labelled corpora (text, label) --------
CORPORA = {
    "twitter": ("Text", "Sentiment"),
    "imdb": ("review", "sentiment"),
    "german": ("Text", "Sentiment"),
    "airline": ("text", "airline_sentiment"),
    "tomatoes": ("Text", "Rating"),
}
TWITTER140_COLUMNS = ["target", "weird_number", "date", "query", "user", "text"]
SURVEY_COLUMNS = {"Comments": "comment_raw", "Report Grouping": "report_grouping", "Question Text": "question_text"}
# -----------------------------------------------------------------------------


def normalise_names(df: DataFrame) -> DataFrame:
    """strip, lowercase and replace spaces by underscores in column names."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def read_survey(spark: SparkSession, path: str, sep: str = ";", multi_line: bool = False) -> DataFrame:
    """S1 + F1 + F3: survey CSV -> ``(doc_id, comment_raw, report_grouping, question_text)``.

    All columns are read as strings; optional columns become nulls (both names
    are tested).  ``doc_id`` is a hash of the row's content and of its number among
    equal rows, so it does not depend on splits or file layout.  ``multi_line``
    allows line breaks in quotes, at the price of one task per file.
    """
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line) \
                   .option("escape", '"').option("inferSchema", False).csv(path)
    cols = []
    for src, dst in SURVEY_COLUMNS.items():
        cols.append(F.col(f"`{src}`").cast("string").alias(dst) if src in df.columns else F.lit(None).cast("string").alias(dst))
    rows = df.select(*cols)
    key = F.xxhash64(*rows.columns)
    copies = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    numbered = copies.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")))
    return numbered.select(F.when(F.col("_i") == 1, key).otherwise(F.xxhash64(*rows.columns, "_i")).alias("doc_id"), *rows.columns)


def read_labelled_corpus(spark: SparkSession, path: str, corpus: str, multi_line: bool = False) -> DataFrame:
    """Header CSV projected to ``(text, label)`` by the corpus' column names."""
    text, label = CORPORA[corpus]
    r = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if corpus == "tomatoes":
        r = r.option("encoding", "ISO-8859-1")
    return r.csv(path).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))


def read_twitter140(spark: SparkSession, path: str) -> DataFrame:
    """S3: headerless Latin-1 CSV with six given names -> ``(text, label)``."""
    schema = ", ".join(f"{c} string" for c in TWITTER140_COLUMNS)
    df = spark.read.schema(schema).option("encoding", "ISO-8859-1").csv(path)
    return df.select("text", F.col("target").alias("label"))


def read_headerless_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Positional TSV columns ``_c0`` (text), ``_c1`` (label)."""
    df = spark.read.option("sep", "\t").schema("_c0 string, _c1 string").csv(path)
    return df.select(F.col("_c0").alias("text"), F.col("_c1").alias("label"))


def read_xml_documents(spark: SparkSession, path: str, row_tag: str = "Document") -> DataFrame:
    """XML source, one row per ``Document`` element -> ``(text, label)``."""
    df = spark.read.format("xml").option("rowTag", row_tag).schema("text string, sentiment string").load(path)
    return df.select(F.col("text").cast("string").alias("text"), F.col("sentiment").cast("string").alias("label"))


def split_by_question(df: DataFrame, question_col: str, questions: list[str]) -> DataFrame:
    """S7 + F5: keep the listed questions; downstream groups by the question column
    instead of building one frame per question."""
    return df.filter(F.col(question_col).isin(questions))


def read_lexicon(spark: SparkSession, path: str, skip: int = 30) -> DataFrame:
    """Tab file, first ``skip`` lines skipped, word = text before the first '#'.

    A lexicon is one file of bounded size: it is read as one split (``wholetext``),
    and ``ord`` is the line number, for the first-wins rule.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
    parts = F.split("line", "\t")
    return lines.filter(F.col("ord") >= skip) \
                .select(F.split(parts[0], "#")[0].alias("word"), F.get(parts, F.lit(1)).try_cast("double").alias("score"),
                        F.col("ord").cast("bigint").alias("ord")) \
                .filter(F.col("score").isNotNull())


def read_answers(spark: SparkSession, path: str, column: str = "answers", multi_line: bool = False) -> DataFrame:
    """Comma CSV, one text column (pruned by Catalyst)."""
    return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path) \
                .select(F.col(column).alias("text"))


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """S9 + E3: column-pruned CSV scan with distinct rows."""
    return spark.read.option("header", True).csv(path).select(*columns).dropDuplicates()


def read_token_vectors(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pretrained vectors ``(token, vec array<float>)`` from Parquet or a text
    ``.vec`` file (header line ``n d`` skipped; ``token v1 v2 ...``)."""
    if fmt == "parquet":
        return spark.read.parquet(path).select("token", F.col("vec").cast("array<float>"))
    raw = spark.read.text(path)
    parts = F.split(F.trim("value"), " ")
    df = raw.select(parts.alias("p")).filter(F.size("p") > 2)
    return df.select(F.col("p")[0].alias("token"),
                     F.slice("p", 2, F.size("p") - 1).cast("array<float>").alias("vec")) \
        .groupBy("token").agg(F.min("vec").alias("vec"))  # a repeated token: the least vector


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run table (empty frame with the run schema when absent)."""
    from sift.operators.runs import RUN_SCHEMA
    from sift.sources.sinks import path_exists
    if not path_exists(spark, path):
        return spark.createDataFrame([], RUN_SCHEMA + ", timestamp timestamp")
    return spark.read.parquet(path)
