"""The Kneser-Ney model against a plain dictionary implementation."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sift.llm import kneser_ney as kn

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, score string, held_out string"


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["</s>"]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute(rows):
    """(tokens, types, {row: ...}, p(w|h)) by dictionaries."""
    uni, bi, texts = Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            w = words(t)
            texts += 1
            uni.update(w)
            bi.update(zip(["<s>", *w[:-1]], w))
    before = Counter(w for _, w in bi)
    of, of1 = Counter(bi.values()), Counter(before.values())
    d, d1 = ([0, *kn.discounts(*(x[i] for i in (1, 2, 3, 4)))] for x in (of, of1))
    total, types, n = sum(before.values()), len(uni), sum(uni.values())
    g1 = sum(d1[min(c, 3)] for c in before.values()) / total if total else 1.0
    ctx, gamma = Counter(), Counter()
    for (h, _), c in bi.items():
        ctx[h] += c
        gamma[h] += d[min(c, 3)]

    def p1(w):
        k = before[w]
        return (max(k - d1[min(k, 3)], 0) / total if total else 0) + g1 / (types + 1)

    def p(h, w):
        if not ctx[h]:
            return p1(w)
        c = bi[h, w]
        return max(c - d[min(c, 3)], 0) / ctx[h] + gamma[h] / ctx[h] * p1(w)
    out = []
    for i, t in rows:
        w = words(t)
        out.append((str(i), held(i), len(w), sum(uni[x] > 0 for x in w), n,
                    sum(math.log10((uni[x] + 1) / (n + types + 1)) for x in w),
                    sum(math.log10(p(h, x)) for h, x in zip(["<s>", *w[:-1]], w))))
    return out, p, uni, ctx


def corpus(seed, n=200):
    r = random.Random(seed)
    vocab = [f"w{int(r.paretovariate(0.6))}" for _ in range(400)] + ["É", "Hot"] * 50
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 60)))) for i in range(n)]
    rows += [(None, None), (None, "w1 Hot"), (5, ""), (5, rows[5][1]), (6, " \t\n"), (2, "new unseen words " * 20),
             (777, "Hot " * 20_000), (778, "hot x " * 500)]
    return rows


def same(got, want):
    got = sorted([(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got])
    want = sorted(want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("seed,bucket_bytes,flush", [(0, 1 << 24, 1 << 22), (1, 2000, 500), (2, 50_000, 100)])
def test_scores(spark, monkeypatch, seed, bucket_bytes, flush):
    monkeypatch.setattr(kn, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(kn, "FLUSH", flush)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    same(kn.score(df).collect(), brute(rows)[0])


def test_probabilities_sum_to_one():
    rows = corpus(3)
    _, p, uni, ctx = brute(rows)
    for h in [*list(ctx)[:20], "never seen"]:
        assert sum(p(h, w) for w in [*uni, "some unknown word"]) == pytest.approx(1.0)


def test_beats_the_base_on_held_out_text(spark):
    r = random.Random(8)
    follow = {f"w{i}": [f"w{r.randrange(80)}" for _ in range(3)] for i in range(80)}
    rows = []
    for i in range(300):
        t = ["w0"]
        while len(t) < 80:
            t.append(r.choice(follow[t[-1]]))
        rows.append((i, " ".join(t)))
    got = {x.held_out: x for x in kn.perplexity(kn.score(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert got[True].perplexity < 0.2 * got[True].base_perplexity and got[True].perplexity < 4


def test_edges(spark):
    assert kn.score(spark.createDataFrame([], SCHEMA)).count() == 0
    only_held = [(i, "a b") for i in range(100) if held(i)]
    got = kn.score(spark.createDataFrame(only_held, "doc_id bigint, text string")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == 0 for r in got)
    rows = [(1, None)]
    same(kn.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), brute(rows)[0])


def test_pack():
    c = np.array([1, 254, 255, 256, 10**12, 3])
    assert kn._unpack(kn._pack(c), 6).tolist() == c.tolist()


def test_discounts_are_defined():
    assert kn.discounts(0, 0, 0, 0) == (0.5, 1.0, 1.5)
    assert all(0 <= d <= i + 1 for i, d in enumerate(kn.discounts(10, 5, 4, 100)))


def brute_order(rows, order):
    """log10 probability of every row by dictionaries of tuples."""
    top, uni = [Counter() for _ in range(order + 1)], Counter()
    grams = lambda w: [tuple(["<s>", *w][max(0, i + 2 - order): i + 2]) for i in range(len(w))]
    for i, t in rows:
        if not held(i):
            uni.update(words(t))
            for g in grams(words(t)):
                top[len(g)][g] += 1
    for n in range(order - 1, 0, -1):
        for g in top[n + 1]:
            top[n][g[1:]] += 1
    d, total, gamma = {}, Counter(), Counter()
    for n in range(1, order + 1):
        of = Counter(top[n].values())
        d[n] = [0, *kn.discounts(*(of[i] for i in (1, 2, 3, 4)))]
        for g, c in top[n].items():
            total[g[:-1]] += c
            gamma[g[:-1]] += d[n][min(c, 3)]

    def p(g):
        low = p(g[1:]) if len(g) > 1 else 1 / (len(uni) + 1)
        if not total[g[:-1]]:
            return low
        c = top[len(g)][g]
        return (max(c - d[len(g)][min(c, 3)], 0) + gamma[g[:-1]] * low) / total[g[:-1]]
    return [(str(i), sum(math.log10(p(g)) for g in grams(words(t)))) for i, t in rows]


@pytest.mark.parametrize("order,bucket_bytes,flush", [(3, 2000, 500), (4, 50_000, 1 << 22)])
def test_higher_orders(spark, monkeypatch, order, bucket_bytes, flush):
    monkeypatch.setattr(kn, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(kn, "FLUSH", flush)
    rows = corpus(order)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((str(r.doc_id), r.score) for r in kn.score(df, order=order).collect())
    want = sorted(brute_order(rows, order))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-9, abs=1e-9)
    two = dict(brute_order(rows, 2))  # the plain version agrees with the other one at order 2
    assert all(two[x[0]] == pytest.approx(x[6]) for x in brute(rows)[0] if [str(i) for i, _ in rows].count(x[0]) == 1)


def test_edges_of_order_three(spark):
    assert kn.score(spark.createDataFrame([], SCHEMA), order=3).count() == 0
    only_held = [(i, "a b") for i in range(100) if held(i)]
    got = kn.score(spark.createDataFrame(only_held, "doc_id bigint, text string"), order=3).collect()
    assert got and all(r.train_tokens == 0 and r.score == 0 for r in got)
    got = kn.score(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), order=3).collect()
    assert got[0].score == pytest.approx(brute_order([(1, None)], 3)[0][1])
