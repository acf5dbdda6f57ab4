"""Training-data pipeline: quality, near copies, benchmark leaks, source mix, token ids.

Each stage takes the documents that its predecessor kept and returns them with
the columns of ``documents``; the last returns one row per document with its
place in the written token-id files.  Between stages the documents are written
as Parquet in the shared folder, so a lost executor never repeats more than a
stage.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sift.llm import mixing, quality, rangecoder, trie_join, winnow  # noqa: E402
from sift.llm.common import bounded_batches, shared_path, table  # noqa: E402
from sift.llm.queries import MIX_TARGETS, domain_table  # noqa: E402


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against the good texts of ``labels``: rejected documents go."""
    bounded_batches(spark)
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component the document of the smallest id stays."""
    bounded_batches(spark)
    return trie_join.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Winnowing: documents that hold a window of a benchmark item go."""
    bounded_batches(spark)
    return winnow.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Soft-membership mixing: documents are drawn by the rates that meet the target weights."""
    return mixing.keep(docs, domain_table(spark, sf_dir), MIX_TARGETS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Range-coded id files: ``(doc_id, start, n_tokens, ids_crc32)`` as read back from them."""
    bounded_batches(spark)
    return rangecoder.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", near_copies),
          ("benchmark decontamination", decontamination), ("mixing sources", source_mix), ("token-id output", token_ids)]

#: SQL cannot express the tokenizer and the sampled stages; tests hold the run against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_path(spark, f"stage-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
