"""Winnowing and top-k against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sift.llm import topk, winnow

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        if n and i is not None:
            for a in range(len(w) - n + 1):
                wins.setdefault(tuple(w[a:a + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                ids = wins.get(tuple(w[a:a + n]))
                if ids:
                    hit.update(range(a, a + n))
                    found |= ids
        out.append((str(d), len(w), len(hit), len(found), winnow.items_digest(found), bool(hit)))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    vocab = ["A", "b", "É", "ß9", "the", "x-y", "Ω", "1", "of"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 9, 10, 11, 40]))) for i in range(12)] + [(3, None), (None, text(12)), (90, "")]
    docs = [(i, text(r.randint(0, 60))) for i in range(60)]
    for i in range(25):
        t = r.choice(items)[1] or ""
        a = r.randint(0, 8)
        docs.append((100 + i, text(5) + "!! " + " ".join(t.split()[a:]).upper() + "\n" + text(5)))
    docs += [(None, None), (None, items[5][1]), (7, ""), (7, docs[3][1]), (7, docs[3][1]), (999, "lone " * 30_000 + (items[6][1] or ""))]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block_words,k", [(10**6, 5), (25, 5), (10**6, 10), (10**6, 1)])
def test_winnowing(spark, seed, block_words, k):
    docs, items = corpus(seed)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, spans string, n_words int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = winnow.report(winnow.contamination_spans(d, b, k=k, block_words=block_words)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute(docs, items)


def test_winnowing_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    b = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r.n_words, r.spans, r["items"]) for r in winnow.contamination_spans(d, b).collect()] == [(3, [], [])]
    assert winnow.contamination_spans(d.limit(0), b).count() == 0
    assert winnow.clean_documents(d, b).collect() == d.collect()


@pytest.mark.parametrize("block_words", [10**6, 25])
def test_clean_documents(spark, block_words):
    docs, items = corpus(7)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = winnow.clean_documents(d, b, block_words=block_words).collect()
    clean = sorted((str(i), str(t)) for i, t in docs if not brute([(i, t)], items)[0][-1])
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == clean


def test_clean_documents_keeps_columns(spark):
    item = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, item.upper(), "p"), (2, "clean", "q"), (None, "null id", None)],
                              "doc_id bigint, text string, items string")
    kept = winnow.clean_documents(d, spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert kept.columns == d.columns and {r.text for r in kept.collect()} == {"clean", "null id"}


def naive(rows, k, mod):
    ok = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    out = []
    for q in sorted({i for i, _ in ok if i % mod == 0}):
        qv = min(v for i, v in ok if i == q)
        s = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv))
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return out


@pytest.mark.parametrize("lists,block", [(1, 1024), (2, 3), (5, 1024), (64, 2)])
def test_topk(spark, lists, block):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(200, 260)]  # copies: ties
    rows += [(300, None), (301, []), (302, [1.0, None] * 3), (310, [float("nan")] * 6), (320, [float("inf")] * 6),
             (330, [0.5] * 4), (331, [0.25] * 4), (None, [1.0] * 6), (10, [2.0] * 6), (11, rows[11][1]), (340, [0.0] * 6),
             (341, [-9.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, score int, rank int")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=7, lists=lists, block=block).collect()
    assert sorted(map(tuple, got)) == sorted(naive(rows, 7, 10))


def test_topk_few_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0]), (1, [-2.0]), (2, [3.0])], schema)
    assert [tuple(r) for r in topk.top_k(one, F.col("vec_id") == 0).orderBy("rank").collect()] == [
        (0, 1, 2, 1024 * 3 * 1024), (0, 2, 1, -2048 * 1024)]
