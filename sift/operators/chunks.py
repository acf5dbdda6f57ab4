"""Gaps-and-islands phrase chunks on the long token table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def continuous_chunks(long: DataFrame, tagged: Column, id_col: str = "doc_id") -> DataFrame:
    """Merge runs of adjacent tagged tokens into space-joined phrases; distinct per document.

    ``tagged`` is any boolean Column over the long table (a lexicon-join flag,
    a capitalisation test, ...).  Island key = ``pos - rank among tagged
    tokens``; the window partitions by document, a group bounded by one text.
    A run that ends the text is kept.
    """
    t = long.filter(tagged)
    w = Window.partitionBy(id_col).orderBy("pos")
    isl = t.withColumn("_island", F.col("pos") - F.row_number().over(w))
    phrases = (isl.groupBy(id_col, "_island")
                  .agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("_l"))
                  .select(id_col, F.array_join(F.transform("_l", lambda x: x["token"]), " ").alias("phrase")))
    return phrases.distinct()
