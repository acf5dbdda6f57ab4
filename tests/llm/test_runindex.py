"""Repeat removal against brute force, and the run-length index against plain matching statistics."""

import hashlib
import random

import numpy as np
import pytest

from sift.llm import runindex

SCHEMA = "doc_id bigint, text string, th bigint, a string, spans string, kept string"


def brute(rows, length):
    """Per row, in the order of the corpus: every string that starts earlier."""
    keyed = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][2], i))
    seen, out = set(), {}
    for i in keyed:
        b = (rows[i][1] or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                gone[s:s + length] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out[i] = (str(rows[i][0]), len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return sorted(out.values())


def with_hash(spark, rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "n int, text string")
    th = {r.n: r.th for r in df.select("n", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()}
    return [(i, t, th[n]) for n, (i, t) in enumerate(rows)]


def corpus(seed):
    r = random.Random(seed)
    text = lambda n, alphabet="abcdé ": "".join(r.choice(alphabet) for _ in range(n))
    shared = [text(n) for n in (40, 90, 250)]
    docs = []
    for i in range(50):
        parts = [text(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(shared), text(r.randint(0, 30))]
        docs.append("".join(parts))
    for _ in range(20):  # near copies
        t = list(r.choice(docs) or "x")
        t[r.randrange(len(t))] = "#"
        docs.append("".join(t))
    docs += [docs[3], docs[4], "ab" * 300, "aba" * 200, "a" * 700, "ab" * 100, "z" * 99, "z" * 100, "é" * 150]
    rows = list(enumerate(docs))
    r.shuffle(rows)
    return rows + [(None, None), (None, docs[5]), (None, docs[5]), (700, None), (701, ""), (3, docs[9]), (3, docs[9]), (3, docs[8])]


@pytest.mark.parametrize("seed,length,k,ranks,flush", [(0, 30, 8, 12, 1 << 20), (1, 30, 30, 2, 1 << 20), (2, 50, 16, 12, 60),
                                                       (3, 30, 8, 1, 60), (4, 100, 32, 3, 200), (5, 20, 5, 0, 40)])
def test_against_brute_force(spark, monkeypatch, seed, length, k, ranks, flush):
    monkeypatch.setattr(runindex, "RANKS", ranks)
    monkeypatch.setattr(runindex, "FLUSH", flush)
    rows = with_hash(spark, corpus(seed))
    df = spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t, _ in rows], SCHEMA).repartition(5)
    got = runindex.remove_repeats(df, length, k).collect()
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == brute(rows, length)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(runindex, "PIECE", 500)
    monkeypatch.setattr(runindex, "INDEX_BYTES", 300)
    r = random.Random(1)
    base = "".join(r.choice("abcdefgh") for _ in range(3000))
    rows = with_hash(spark, [(1, base), (2, base[700:2500]), (3, "x" + base), (4, base[:1234] + "!" + base[1234:] + base[100:900]), (5, base[::-1])])
    got = runindex.remove_repeats(spark.createDataFrame([x[:2] for x in rows], "doc_id bigint, text string"), 40, 12).collect()
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == brute(rows, 40)


def test_matching_statistics():
    rng = np.random.default_rng(3)
    for alphabet, n in ((2, 60), (4, 200), (255, 50), (1, 40)):
        texts = [rng.integers(0, alphabet, rng.integers(1, n)).astype(np.uint8).tobytes() for _ in range(8)]
        texts += [texts[0], texts[1][: len(texts[1]) // 2 + 1]]
        queries = [rng.integers(0, alphabet, rng.integers(1, n)).astype(np.uint8).tobytes() for _ in range(6)]
        queries += [texts[2], texts[3] + b"\xfe" + texts[4], b"\xff"]
        pack = lambda xs: (np.frombuffer(b"".join(xs), np.uint8), np.cumsum([0] + [len(x) for x in xs]))
        got = runindex.RunIndex(*pack(texts)).matching_statistics(*pack(queries))
        at = 0
        for q in queries:
            for i in range(len(q)):
                want = max(m for m in range(len(q) - i + 1) if m == 0 or any(q[i:i + m] in t for t in texts))
                assert got[at] == want, (q, i)
                at += 1


def test_runs_are_few_in_repetitive_text():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 20, 150).astype(np.uint8)
    index = runindex.RunIndex(np.tile(text, 40), np.arange(41) * 150)
    assert index.runs < 400  # of 6,040 signs


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert runindex.remove_repeats(empty).count() == 0
    got = runindex.remove_repeats(spark.createDataFrame([(1, None), (2, "short"), (2, "short")], "doc_id bigint, text string")).collect()
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got) == [
        (1, 0, 0, 0, b""), (2, 5, 0, 0, b"short"), (2, 5, 0, 0, b"short")]
