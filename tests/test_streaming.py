"""Streaming keyword counts equal the batch counts on the same files."""

import tempfile

from pyspark.sql import functions as F

from sift.functions import text as T
from sift.streaming.keywords import comment_stream, keyword_counts
from tests.conftest import SF001


def test_stream_counts_equal_batch(spark):
    s = comment_stream(spark, SF001, file_glob="documents.parquet")
    q = (keyword_counts(s).writeStream.outputMode("complete").format("memory")
         .queryName("kw_stream").option("checkpointLocation", tempfile.mkdtemp(prefix="sift-ss-")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r.source, r.token): r.cnt for r in spark.sql("SELECT * FROM kw_stream").collect()}
    b = spark.read.parquet(f"{SF001}/documents.parquet")
    want = {(r.source, r.token): r.cnt for r in
            b.select("source", F.explode(T.keyword_tokens("text")).alias("token"))
             .groupBy("source", "token").count().withColumnRenamed("count", "cnt").collect()}
    assert got == want and len(got) > 0


def test_written_counts_survive_a_batch_that_runs_twice(spark):
    import os
    from sift.streaming.keywords import latest_counts, start_keyword_counts
    d = tempfile.mkdtemp(prefix="sift-ss-")
    q = start_keyword_counts(comment_stream(spark, SF001, file_glob="documents.parquet"), f"{d}/out", f"{d}/ck")
    q.processAllAvailable()
    q.stop()
    want = {(r.source, r.token): r.cnt for r in latest_counts(spark, f"{d}/out").collect()}
    b = spark.read.parquet(f"{SF001}/documents.parquet")
    assert sum(want.values()) == b.select(F.explode(T.keyword_tokens("text"))).count()
    # the commit of the last batch is lost: it runs again
    commits = f"{d}/ck/commits"
    for f in os.listdir(commits):
        os.replace(f"{commits}/{f}", f"{d}/{f}.lost")
    q = start_keyword_counts(comment_stream(spark, SF001, file_glob="documents.parquet"), f"{d}/out", f"{d}/ck")
    q.processAllAvailable()
    q.stop()
    assert {(r.source, r.token): r.cnt for r in latest_counts(spark, f"{d}/out").collect()} == want
