"""Runs of words against brute force, at the level of ids and through Spark."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sift.llm import periodic
from sift.llm.periodic import find_runs, interval_runs, run_report, runs_of

DOCS = "doc_id bigint, text string, runs string, collapsed string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q):
                found.setdefault((start, i - start + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_words(r):
    n, k = r.choice([0, 1, 5, 6, 7, 24, 90]), r.choice([1, 2, 2, 3, 6])
    w = [r.randrange(k) for _ in range(n)]
    if n and r.random() < 0.5:
        a, p = r.randrange(n), r.randint(1, 9)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_ids_against_brute_force():
    r = random.Random(3)
    for _ in range(400):
        texts = [random_words(r) for _ in range(r.randint(1, 6))]
        first = np.cumsum([0, *map(len, texts)]).astype(np.int64)
        got = [tuple(x) for x in runs_of(np.array(sum(texts, []), np.int64), first).tolist()]
        assert got == [(s + int(f), n, q) for f, w in zip(first, texts) for s, n, q in brute_runs(w)]


def test_pairs_decide(monkeypatch):
    """Without the interval tree there is no run: nothing else finds them."""
    words, first = np.array([1, 2] * 8, np.int64), np.array([0, 16], np.int64)
    assert runs_of(words, first).tolist() == [[0, 16, 2]]
    monkeypatch.setattr(periodic, "interval_runs", lambda *a: None)
    assert not len(runs_of(words, first))


def test_interval_tree_by_hand():
    out = []
    # abababab: suffixes 6 4 2 0 share 2, 4, 6 words; positions 0 and 2 are the pair of the run
    interval_runs([6, 4, 2, 0], [2, 4, 6], np.array([-1, 1, 2, 1, 2, 1, 2, 1]), out)
    assert out == [(0, 8, 2)]


def test_long_text_of_one_word_and_of_long_periods():
    n = 60_000
    assert runs_of(np.zeros(n, np.int64), np.array([0, n])).tolist() == [[0, n, 1]]
    assert runs_of(np.arange(n) % (n // 4), np.array([0, n])).tolist() == [[0, n, n // 4]]
    assert not len(runs_of(np.arange(n) % (n // 4 + 1), np.array([0, n])))


TEXTS = [None, "", " \t\n", "one", "a a a a a a", "A a a a a a a", "x y x y x y x y z", "a b a b a b a",
         "é é\té\né é\x0bé ü", "b b b b b b b b b b b b", "q " * 3000, ("lorem ipsum dolor " * 5) * 200]


def rows(seed=5):
    r = random.Random(seed)
    texts = TEXTS + [" ".join("abcdefg"[x] * (x + 1) for x in random_words(r)) for _ in range(150)]
    return [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, TEXTS[6], None, None), (3, TEXTS[6], "", ""), (3, TEXTS[6], "", "")]


def test_operator_against_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame(data, DOCS).withColumnRenamed("doc_id", "id").repartition(5)
    got = sorted((str(r.id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(docs).collect())
    want = []
    for i, t, _, _ in data:
        w = WORD.findall(t or "")
        runs = brute_runs(w)
        want.append((str(i), len(w), runs, collapsed(w, runs)))
    assert got == sorted(want)


def planted(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_report_against_brute_force(spark):
    data = rows(9)
    got = sorted(tuple(map(str, r)) for r in run_report(spark.createDataFrame(data, DOCS)).collect())
    want, moved = [], 0
    for i, t, _, _ in data:
        w = planted(i, t)
        moved += w != WORD.findall(t or "")
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((i, len(runs), *(best if best else (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest()))
    assert moved and got == sorted(tuple(map(str, x)) for x in want)


def test_empty_table(spark):
    out = run_report(spark.createDataFrame([], DOCS))
    assert out.count() == 0 and out.columns[:2] == ["doc_id", "n_runs"]


@pytest.mark.parametrize("size", [1, 3000])
def test_chunks_do_not_matter(spark, monkeypatch, size):
    docs = spark.createDataFrame(rows(), DOCS).selectExpr("doc_id as id", "text").collect()
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"id": [r.id for r in docs], "text": [r.text for r in docs]})
    whole = [r for b in periodic._find([batch]) for r in b.to_pylist()]
    chunks = periodic.chunks
    monkeypatch.setattr(periodic, "chunks", lambda c: chunks(c, size))
    assert [r for b in periodic._find([batch]) for r in b.to_pylist()] == whole
