"""Archives: round trip, index, byte ranges, revisits."""

import base64
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from sift.llm import warc
from sift.llm.warc import archived_pages, index_archives, read_records, write_archives

PAGES = "page_id bigint, url string, html string, payload string, refers_to string"


def pages(n=300, seed=2):
    r = random.Random(seed)
    texts = ["", None, "plain", "<p>é ü 漢字 \r\n\r\n WARC/1.1\r\n</p>", "x" * 200_000, "a\r\n\r\nb"] + [f"<i>{i}</i>" * 20 for i in range(40)]
    return [(i, r.choice([None, "", "http://a/\r\nInjected: x", f"http://h/é {i}"]), r.choice(texts), "clash", "clash") for i in range(n)]


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows, least=0):
    last = {}
    for i, _, html, *_ in rows:
        if i is not None:
            last[html or ""] = max(last.get(html or "", i), i)
    out = []
    for i, _, html, *_ in rows:
        data, first = (html or "").encode(), last.get(html or "")
        other = first if first is not None and first != i and len(data) >= least and sum((x[2] or "") == (html or "") for x in rows) > 1 else None
        out.append((i, len(data), digest(data), "response" if other is None else "revisit", other))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip_against_plain_version(spark, least):
    rows = pages() + [(None, None, "plain", "", ""), (299, "http://again/", "plain", "", ""), (299, "http://again/", "plain", "", ""), (-5, "u", "neg", "", "")]
    got = archived_pages(spark.createDataFrame(rows, PAGES).repartition(6), least).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows, least)


def test_records_urls_and_payloads(spark):
    rows = [(i, u, h, None, None) for i, (u, h) in enumerate([(None, "a"), ("http://x/?q=1", "b\r\n\r\nc"), ("http://x/\n\r", "é"), ("", "")])]
    index = write_archives(spark.createDataFrame(rows, PAGES).selectExpr("page_id id", "url", "html payload"))
    got = {r.id: r for r in read_records(index).collect()}
    assert {i: r.payload for i, r in got.items()} == {0: "a", 1: "b\r\n\r\nc", 2: "é", 3: ""}
    assert [got[i].url for i in range(4)] == [None, "http://x/?q=1", "http://x/%0A%0D", ""]


def test_selected_records_only_and_plain_gzip(spark, tmp_path):
    rows = pages(120)
    index = write_archives(spark.createDataFrame(rows, PAGES).selectExpr("page_id id", "url", "html payload"), f"file:{tmp_path}/w")
    listed = index.collect()
    files = [f for f in os.listdir(f"{tmp_path}/w") if f.endswith(".warc.gz")]
    assert files and sum(r.length for r in listed) == sum(os.path.getsize(f"{tmp_path}/w/{f}") for f in files)
    whole = {f: gzip.open(f"{tmp_path}/w/{f}").read() for f in files}  # members of one gzip file
    assert sum(x.count(b"WARC/1.1\r\nWARC-Type: ") for x in whole.values()) == len(rows)
    some = index.filter(F.col("id") % 7 == 3)
    got = read_records(some).collect()
    assert {r.id for r in got} == {i for i, *_ in rows if i % 7 == 3}
    assert all(r.payload == (rows[r.id][2] or "") for r in got if r.record_type == "response")


def test_index_of_existing_archives_equals_the_written_one(spark, tmp_path):
    index = write_archives(spark.createDataFrame(pages(80), PAGES).selectExpr("page_id id", "url", "html payload"), f"file:{tmp_path}/w")
    again = index_archives(spark, f"file:{tmp_path}/w")
    cut = lambda df: sorted(((os.path.basename(r.file), r.offset, r.length, r.payload_digest, r.payload_bytes, r.record_type, r.id, r.refers_to)
                             for r in df.collect()))
    assert cut(again) == cut(index)


def test_damaged_archive_is_an_error(spark, tmp_path):
    index = write_archives(spark.createDataFrame([(1, "u", "payload" * 50, "", "")], PAGES).selectExpr("page_id id", "url", "html payload"), str(tmp_path))
    name = index.first().file
    raw = bytearray(open(name, "rb").read())
    raw[-9] ^= 0xFF
    open(name, "wb").write(raw)
    with pytest.raises(Exception):
        read_records(index).collect()


def test_ranges_are_joined():
    assert list(warc._ranges([0, 10, 200_000, 200_050], [10, 5, 50, 10])) == [(0, 15, 0, 2), (200_000, 200_060, 2, 4)]
    assert len(list(warc._ranges([0, warc.READ], [warc.READ, 5]))) == 2


def test_empty_table(spark):
    assert archived_pages(spark.createDataFrame([], PAGES)).count() == 0
