"""Importance resampling and soft-membership mixing against brute force, with edge cases."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sift.llm import mixing, quality

DOCS = "doc_id bigint, text string, log_weight string, p string, rate string, n_tokens string, _text_hash string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in rows], DOCS)


def corpus(n=600, seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(20, 120))]
        kind = r.random()
        if kind < 0.12:
            words[3:3] = ["vile", "nasty"]
        elif kind < 0.24:
            words = [w + "***" for w in words]
        docs.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(not 0.12 <= kind < 0.24), int(kind < 0.12)))
    return docs, labels


def brute_features(text):
    """Feature names of a text, as the module describes them."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    out = {("word", w) for w in words}
    count = {}
    for a, b in zip(words, words[1:]):
        if a == b:
            count["same"] = count.get("same", 0) + 1
    for s in re.findall(r"[\x00-\x08\x0e-\x1f\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low):
        count["sym", s] = count.get(("sym", s), 0) + 1
    for s, c in count.items():
        for level in quality.LEVELS:
            if math.log2(c / max(len(words), 1)) >= level:
                out.add((s, level))
    return out


def test_features_against_brute_force():
    texts = ["", "a a b!! c!! A", "***", "é É | x | y || z", "one", "no no no no " * 50, "\t\n", "a.b.c d@e"]
    data = "".join(texts).encode()
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    rows, buckets = quality.features(np.frombuffer(data, np.uint8), offs)
    got = [set(buckets[rows == i].tolist()) for i in range(len(texts))]
    names, seen = [brute_features(t) for t in texts], {}
    assert [len(g) for g in got] == [len(n) for n in names]
    for i in range(len(texts)):  # the same feature has the same bucket in every text
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(names[i] & names[j]), (texts[i], texts[j], seen)


def test_resample_parts_good_from_bad(spark):
    docs, labels = corpus(1500)
    got = quality.resample(frame(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    bad = {i for i, t in docs if "vile" in t or "***" in t}
    kept = {r.doc_id for r in got if r.kept}
    assert len(got) == len(docs)
    held_out = [i for i, _ in docs if i % 2 == 0]
    assert sum((i in kept) != (i not in bad) for i in held_out) <= 0.03 * len(held_out)
    rows = quality.keep(frame(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert {r.doc_id for r in rows.collect()} == kept and rows.columns == frame(spark, []).columns


def test_weights_against_brute_force(spark):
    docs, labels = corpus(1200)
    d = frame(spark, docs)
    sample = quality.labelled_sample(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    ratio = quality.log_ratios(d, sample)
    good = {i for i, q, t in labels if q == 1 and t == 0}
    raw, target = {}, {}
    feats = {i: brute_features(t) for i, t in docs}
    for i, f in feats.items():
        for x in f:
            raw[x] = raw.get(x, 0) + 1
            target[x] = target.get(x, 0) + (i in good)
    n, n_t = len(docs), len(good)
    lam = {}
    for x, c in raw.items():
        p = c / n
        if p * n_t - target[x] >= quality.Z * math.sqrt(n_t * p * (1 - p) + 1e-12):
            lam[x] = min(0.0, math.log((target[x] + quality.PRIOR * p) / (n_t + quality.PRIOR) / p))
    want = {i: sum(lam.get(x, 0.0) for x in f) for i, f in feats.items()}
    got = d.select("doc_id", quality.log_weight(spark.sparkContext.broadcast(ratio)).alias("w")).collect()
    assert any(want.values())
    for r in got:
        assert r.w == pytest.approx(want[r.doc_id], abs=1e-5)


@pytest.mark.parametrize("k", [1, 2, 50, 997, 1000])
def test_kth_largest(spark, k):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=400), np.zeros(500), [-1e9, 1e9] * 50])
    df = spark.createDataFrame([(float(x),) for x in v], "key double")
    assert quality.kth_largest(df, "key", k, bins=16, most=20) == sorted(v, reverse=True)[k - 1]


def test_least_error():
    assert quality.least_error(np.array([1.0, 2, 3, 4]), np.array([False, False, True, True])) == 2.5
    assert quality.least_error(np.array([1.0, 1, 1]), np.array([True, False, True])) == -np.inf
    assert quality.least_error(np.array([1.0, 1, 2]), np.array([False, False, False])) == np.inf


def test_resample_edges(spark):
    labels = "doc_id bigint, quality int, toxic int"
    none = spark.createDataFrame([], labels)
    rows = [(None, None), (None, "x"), (1, None), (1, ""), (2, "word " * 200_000), (2, "word " * 200_000), (3, "***")]
    got = quality.resample(frame(spark, rows), none).collect()
    assert len(got) == len(rows) and sorted(r.log_weight == 0 for r in got) == [False] * 3 + [True] * 4
    assert all(r.kept == (r.log_weight == 0) for r in got)  # a text without n-grams goes
    assert sorted(str(r.text) for r in quality.keep(frame(spark, rows), none).collect()) == sorted(["x", rows[4][1], rows[4][1], "***"])
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 1, None), (2, 1, 0), (2, 0, 0), (3, 0, 0)], labels)
    assert quality.labelled_sample(odd).orderBy("doc_id").collect() == [(2, 0), (3, 0)]
    assert quality.resample(frame(spark, rows), odd).count() == len(rows)
    assert quality.resample(frame(spark, []), odd).count() == 0
    assert quality.keep(frame(spark, []), odd).count() == 0


def lang_rows(n=300, seed=1):
    r = random.Random(seed)
    vocab = {"en": ["the", "of", "and", "x"], "de": ["der", "und", "x", "ß"], "fr": ["le", "é", "et", "x"]}
    out = []
    for i in range(n):
        d = r.choices(list(vocab), [6, 3, 1])[0]
        out.append((i, " ".join(r.choice(vocab[d]) for _ in range(r.randint(1, 60))), d))
    return out


TARGETS = {"en": 0.3, "de": 0.5, "fr": 0.2}


def test_mix_against_brute_force(spark):
    rows = lang_rows()
    labelled = spark.createDataFrame(rows[:100], "doc_id bigint, text string, domain string")
    got = mixing.mix(frame(spark, [(i, t) for i, t, _ in rows]), labelled, TARGETS).orderBy("doc_id").collect()
    # posteriors (words are few, so no two share a bucket)
    count = {d: {} for d in TARGETS}
    for _, t, d in rows[:100]:
        for w in t.split():
            count[d][w] = count[d].get(w, 0) + 1
    total = {d: sum(c.values()) + mixing.SMOOTH * mixing.BUCKETS for d, c in count.items()}
    for (i, t, _), r in zip(rows, got):
        mean = [sum(math.log((count[d].get(w, 0) + mixing.SMOOTH) / total[d]) for w in t.split()) / len(t.split()) for d in TARGETS]
        e = [math.exp(mixing.EVIDENCE * (m - max(mean))) for m in mean]
        for d, x in zip(TARGETS, e):
            assert r[f"p_{d}"] == pytest.approx(x / sum(e), abs=0.0011)
        assert r.n_tokens == len(t.split())
    # the expected totals meet the targets
    held = np.array([sum(r.n_tokens * r[f"p_{d}"] for r in got) for d in TARGETS])
    want = np.array(list(TARGETS.values())) * min(held / np.array(list(TARGETS.values())))
    expected = np.array([sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) for d in TARGETS])
    assert expected == pytest.approx(want, rel=0.01)
    assert all(0 <= r.rate <= 1 for r in got)
    # and no rates do better on the least squares that the method states
    def loss(rate):
        a = np.array([sum(x * r.n_tokens * r[f"p_{d}"] for x, r in zip(rate, got)) for d in TARGETS])
        return (((a - want) ** 2) / held).sum()
    best = loss([r.rate for r in got])
    rng = np.random.default_rng(0)
    for _ in range(20):
        assert loss(np.clip([r.rate for r in got] + rng.normal(0, 0.05, len(got)), 0, 1)) >= best - 1e-6


def test_rates_above_one_and_hard_targets(spark):
    members = spark.createDataFrame([(1, 100, [1.0, 0.0]), (2, 50, [0.0, 1.0]), (1, 10, [0.5, 0.5])],
                                    "copies bigint, n_tokens bigint, p array<double>")
    rates, fit = mixing.fit_rates(members, {"a": 0.2, "b": 0.8}, max_rate=None)
    assert all(r.rate >= 0 for r in rates.collect())
    assert fit["expected"] == pytest.approx(fit["target"], rel=1e-4)
    _, fit = mixing.fit_rates(members, {"a": 0.0, "b": 1.0})
    assert fit["expected"][0] < 0.1 * fit["held"][0]


def test_targets_out_of_reach_end_at_the_least_squares(spark):
    """Taking all of b also takes half of every mixed document's a: more than its target."""
    members = spark.createDataFrame([(1, 100, [0.5, 0.5]), (1, 10, [1.0, 0.0])], "copies bigint, n_tokens bigint, p array<double>")
    rates, fit = mixing.fit_rates(members, {"a": 0.3, "b": 0.7})
    got = {tuple(r.p): r.rate for r in rates.collect()}
    assert got[(1.0, 0.0)] == 0 and 0 < got[(0.5, 0.5)] < 1 and fit["rounds"] < 200
    h, t = fit["held"], fit["target"]
    loss = lambda r: sum((e - x) ** 2 / y for e, x, y in zip((50 * r, 50 * r), t, h))
    assert all(loss(got[(0.5, 0.5)]) <= loss(got[(0.5, 0.5)] + d) + 1e-6 for d in (-0.01, 0.01))


def test_a_scarce_domain_in_traces_is_fitted_in_few_passes(spark):
    """All of a is wanted, and traces of it are in texts whose b is already full: gradients take thousands of rounds."""
    members = spark.createDataFrame([(1, 1000 + 7 * i, [i / 1000, 1 - i / 1000]) for i in range(40)] + [(1, 300, [1.0, 0.0])],
                                    "copies bigint, n_tokens bigint, p array<double>")
    rates, fit = mixing.fit_rates(members, {"a": 0.3, "b": 0.7})
    assert fit["rounds"] < 100 and all(0 <= r.rate <= 1 for r in rates.collect())
    p, w = np.array([r.p for r in members.collect()]), np.array([r.n_tokens for r in members.collect()], float)
    h, t, near = np.array(fit["held"]), np.array(fit["target"]), {tuple(r.p): r.rate for r in rates.collect()}
    x = np.array([near[tuple(v)] for v in p])
    off = ((w * x) @ p - t) / h
    # no rate moves the totals closer: the certificate of the least squares, a bound on its excess
    gain = (w * np.where(p @ off > 0, x, x - 1) * (p @ off)).sum()
    assert gain <= 2 * mixing.EXACT ** 2 * h.sum()


def test_mix_edges(spark):
    rows = [(None, None), (None, "der und"), (1, ""), (2, "le et"), (2, "le et"), (3, "the " * 100_000), (4, " \t\n")]
    labelled = spark.createDataFrame(lang_rows(50) + [(None, "x", "en"), (77, None, "en"), (78, "x", None), (79, "x", "zz")],
                                     "doc_id bigint, text string, domain string")
    d = frame(spark, rows)
    got = mixing.mix(d, labelled, TARGETS)
    assert got.count() == len(rows)
    by = {(r.doc_id, r.n_tokens): r for r in got.collect()}
    assert by[(3, 100_000)].p_en > 0.99 and by[(1, 0)].p_en == pytest.approx(1 / 3, abs=0.001)
    kept = mixing.keep(d, labelled, TARGETS)
    clash = d.withColumn("_text_hash", F.lit("mine")).withColumn("_id", F.lit("own")).withColumn("_hash", F.lit(None).cast("string"))
    assert sorted(map(str, mixing.keep(clash, labelled, TARGETS).collect())) == sorted(
        map(str, kept.withColumn("_text_hash", F.lit("mine")).withColumn("_id", F.lit("own")).withColumn("_hash", F.lit(None).cast("string")).collect()))
    assert kept.columns == d.columns and kept.count() == got.filter("kept").count()
    empty = spark.createDataFrame([], "doc_id bigint, text string, domain string")
    got = mixing.mix(d, empty, TARGETS).collect()
    assert len(got) == len(rows) and all(r.p_en == r.p_de for r in got)
    assert mixing.mix(frame(spark, []), labelled, TARGETS).count() == 0
    assert mixing.keep(frame(spark, []), empty, TARGETS).count() == 0
    assert mixing.mix(d.filter(F.col("doc_id") == 1), labelled, TARGETS).count() == 1
