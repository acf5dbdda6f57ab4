"""Operators without a SQL oracle, checked against brute force or golden rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sift.operators import spelling as SP
from sift.operators import tokens as TK


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, cb in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (ca != cb))
    return d[len(b)]


def test_segment_join_is_exact(spark):
    rng = random.Random(7)
    alpha = "abcde"
    words = sorted({"".join(rng.choice(alpha) for _ in range(rng.randint(1, 8))) for _ in range(300)})
    queries = sorted({"".join(rng.choice(alpha) for _ in range(rng.randint(3, 9))) for _ in range(150)})
    for k in (1, 2, 3):
        got = {(r.query, r.word, r.distance) for r in SP.candidate_pairs(
            spark.createDataFrame([(q,) for q in queries], "query string"),
            spark.createDataFrame([(w,) for w in words], "word string"), k).collect()}
        want = {(q, w, lev(q, w)) for q in queries for w in words if lev(q, w) <= k}
        assert got == want, k


def test_simple_corrector_brute_force(spark):
    known = ["house", "mouse", "horse", "more", "shore", "hose"]
    freq = {"house": 9, "mouse": 3, "horse": 9, "more": 20, "shore": 1, "hose": 2}
    sent = ["hous", "morse", "xyzzy", "house", "hse"]
    words = spark.createDataFrame([(1, 0, i, w) for i, w in enumerate(sent)], "doc_id long, sent_no int, pos int, word string")
    kdf = spark.createDataFrame([(w,) for w in known], "word string")
    out = SP.simple_corrections(words, kdf, kdf,
                                spark.createDataFrame(list(freq.items()), "clean string, freq long"), 2).first()

    def best(w):
        if w in known:
            return w
        c = [(lev(w, k), -freq[k], k) for k in known if lev(w, k) <= 2]
        return min(c)[2] if c else w
    assert out.corrected == [best(w) for w in sent]


def test_clean_token_golden(spark):
    df = spark.createDataFrame([("Don't",), ("co-op!",), ("O'Neil's",), ("Café,",), ("a",), ("''",)], "t string")
    got = [r[0] for r in df.select(SP.clean_token("t")).collect()]
    assert got == ["don't", "co-op", "oneil's", "café", "a", "'"]


def test_first_n_and_shuffle(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    assert [r.doc_id for r in TK.first_n_documents(df, 5).collect()] == [0, 1, 2, 3, 4]
    a = [r.doc_id for r in TK.shuffled(df, 42).collect()]
    assert a == [r.doc_id for r in TK.shuffled(df, 42).collect()] and sorted(a) == list(range(100)) and a != list(range(100))


def test_expand_with_table(spark):
    long = spark.createDataFrame([(1, 0, "u"), (1, 1, "r"), (1, 2, "gr8"), (1, 3, "unusual")],
                                 "doc_id long, pos int, token string")
    exp = spark.createDataFrame([("u", "you"), ("gr8", "great"), ("r", "are")], "key string, expansion string")
    out = TK.regroup_tokens(TK.expand_with_table(long, exp)).first().tokens
    assert out == ["you", "are", "great", "unusual"]


def test_encode_classes(spark):
    from sift.operators.sentiment import encode_classes
    df = spark.createDataFrame([(-1,), (0,), (1,), (1,)], "y int")
    rows = encode_classes(df, "y").orderBy("y").collect()
    assert [r.class_index for r in rows] == [0.0, 1.0, 2.0, 2.0]
    assert [list(r.one_hot.toArray()) for r in rows][0] == [1.0, 0.0, 0.0]


def test_step_parameters_checked(spark):
    from sift.plans.steps import run_steps

    def scale(df, factor=1):
        return df.withColumn("x", F.col("id") * factor)
    df = spark.range(3)
    assert [r.x for r in run_steps(df, [("scale", scale, {"factor": 2})]).collect()] == [0, 2, 4]
    with pytest.raises(ValueError):
        run_steps(df, [("scale", scale, {"threshold": 2})])


def test_batch_scorer(spark):
    from sift.operators.vectors import batch_scorer

    def make():
        def predict(x):
            return np.stack([x, x * 2], axis=1).astype(np.float32)
        return predict
    score = batch_scorer(make, 2, 4)
    df = spark.range(10).select(F.col("id").cast("float").alias("x"))
    got = [list(r.v) for r in df.select(score("x").alias("v")).orderBy(F.col("v")[0]).collect()]
    assert got[3] == [3.0, 6.0]


def test_group_quantile_matches_numpy(spark):
    from sift.operators.stats import group_quantile
    rng = np.random.default_rng(5)
    rows = []
    for g in ("a", "b", "c"):
        n = {"a": 500, "b": 37, "c": 1}[g]
        for v in rng.normal(size=n).round(3):   # rounding creates ties
            rows.append((g, float(v), int(rng.integers(1, 4))))
    df = spark.createDataFrame(rows, "g string, v double, w long")
    for p in (0.0, 0.15, 0.5, 0.999, 1.0):
        got = {r.g: r.q for r in group_quantile(df, "g", "v", p, "w").collect()}
        for g in ("a", "b", "c"):
            expanded = np.repeat([r[1] for r in rows if r[0] == g], [r[2] for r in rows if r[0] == g])
            assert abs(got[g] - np.percentile(expanded, 100 * p)) < 1e-12, (g, p)


def test_titles_count_a_shared_negative_once(spark):
    import math
    from sift.operators.vectors import cosmul_titles
    vec = {"p": [1.0, 0.2], "q": [0.3, 1.0], "s": [0.9, 0.5], "x": [1.0, 0.9], "y": [0.2, 0.7], "z": [0.0, 0.0]}
    kw = [(0, "p"), (0, "s"), (1, "q"), (1, "s"), (2, "s")]
    tv = spark.createDataFrame([(t, v) for t, v in vec.items()], "token string, vec array<double>")
    kd = spark.createDataFrame(kw + [(2, "s")], "cluster int, token string")

    def cos(a, b):
        n = math.hypot(*a) * math.hypot(*b)
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0
    for negatives in (True, False):
        want = {}
        for c in (0, 1, 2):
            own = {w for k, w in kw if k == c}
            other = {w for k, w in kw if k != c}  # a set: s counts once, and also where c owns it too
            score = {}
            for t in ("x", "y", "z"):
                pos = math.prod((1 + cos(vec[t], vec[w])) / 2 for w in own)
                neg = math.prod((1 + cos(vec[t], vec[w])) / 2 for w in other) + 1e-6
                score[t] = pos / neg if negatives else pos
            want[c] = [t for t, _ in sorted(score.items(), key=lambda kv: (-round(math.log(kv[1]), 9), kv[0]))][:2]
        got = {}
        for r in cosmul_titles(tv, kd, "cluster", 2, 2, negatives=negatives).orderBy("cluster", "rank").collect():
            got.setdefault(r.cluster, []).append(r.token)
        assert got == want


def test_distance_three_and_accented_words(spark):
    from sift.operators import spelling as SP
    docs = spark.createDataFrame([(1, "the enviromennts are wörkplce here"), (2, "x co-wroker y")] +
                                 [(10 + i, "our environment wörkplace co-worker") for i in range(11)], "doc_id long, text string")
    pos = SP.positions(docs)
    freq = SP.corpus_frequency(pos)
    words = freq.filter("freq > 10").selectExpr("clean as word")
    errors = SP.detect_errors(pos, freq, words, 10)
    assert {"enviromennts", "wörkplce", "co-wroker"} <= {r.clean for r in errors.collect()}
    q = errors.selectExpr("clean as query").distinct()
    got = {(r.query, r.word): r.distance for r in SP.candidate_pairs(q, words, 3).collect()}
    assert got["enviromennts", "environment"] == 3 and got["wörkplce", "wörkplace"] == 1 and got["co-wroker", "co-worker"] == 2


def test_vocabulary_ids_without_a_cap(spark):
    from sift.operators import tokens as TK
    rows = [(i, t) for i, t in enumerate(["b"] * 5 + ["a"] * 5 + ["c"] + [f"w{i}" for i in range(50)])]
    long = spark.createDataFrame(rows, "doc_id int, token string")
    full = {r.token: r.id for r in TK.vocabulary_ids(long).collect()}
    capped = {r.token: r.id for r in TK.vocabulary_ids(long, 10).collect()}
    assert full["a"] == 2 and full["b"] == 3 and full["c"] == 4 and sorted(full.values()) == list(range(2, 55))
    assert capped == {t: i for t, i in full.items() if i < 10}


def test_tag_operators(spark):
    from sift.operators import tokens as TK
    long = spark.createDataFrame([(1, 0, "cats"), (1, 1, "quickly"), (1, 2, "ran"), (2, 0, "odd")], "doc_id int, pos int, token string")
    table = spark.createDataFrame([("cats", "NOUN", "cat"), ("quickly", "ADV", "quickly"), ("ran", "VERB", "run")],
                                  "token string, pos_tag string, lemma string")
    got = TK.regroup_tokens(TK.normalise_by_tag(long, table, ["NOUN"], ["ADV"]), "doc_id", "t")
    assert {r.doc_id: r.t for r in got.collect()} == {1: ["cat", "ran"], 2: ["odd"]}
    ann = {r.doc_id: [tuple(a) for a in r.annotations] for r in TK.annotations(long, table, 2).collect()}
    assert ann == {1: [("cats", "NOUN", "cat"), ("quickly", "ADV", "quickly")], 2: [("odd", None, None)]}


def test_keyword_pivot_holds_every_cluster(spark, tmp_path):
    from sift.plans.queries import QUERIES
    rows = [(1, "green apples taste sweet", "en", "src3"), (2, "heavy trains arrive late", "en", "src25"), (3, "heavy rain", "de", "src25")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["keyword_pivot"](spark, str(tmp_path))
    assert got.columns == ["question", "3", "25"]
    labels = {r["question"]: r for r in got.collect()}
    assert labels["en"]["3"] and labels["en"]["25"] and labels["de"]["25"] and labels["de"]["3"] is None


def test_word2vec_query_has_a_vector_for_every_token(spark, tmp_path):
    from sift.plans.queries import QUERIES
    rows = [(1, "green apples taste sweet", "en", "src3"), (2, "green trains arrive late", "en", "src4")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["word2vec_vectors"](spark, str(tmp_path)).collect()
    assert {"green", "apples", "trains"} <= {r["token"] for r in got} and all(len(r["vec"]) == 16 for r in got)


def test_text_is_cleaned_as_its_tokens(spark):
    texts = ["Don't co-op! O'Neil's  Café, a '' 'x x' it's' don't", " 'tis\nrock'n'roll ΣΑΣ' ΟΔΟΣ. İx' 𝒳'y", "", "'", "a'\n b's\t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "split(t, ' ', -1) AS w")
    for r in df.select("t", SP.clean_tokens_of_text("t").alias("got"), F.transform("w", lambda x: SP.clean_token(x)).alias("want")).collect():
        assert r.got == r.want, r.t


def test_candidate_pairs_are_not_shuffled(spark):
    q = spark.createDataFrame([("hous",), ("mosue",)], "query string")
    w = spark.createDataFrame([("house",), ("mouse",), ("at",)], "word string")
    pairs = SP.candidate_pairs(q, w, 3)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query" in plan and not [x for x in plan.split("Exchange hashpartitioning(")[1:] if "word" in x.split(")")[0]]
    assert {(r.query, r.word, r.distance) for r in pairs.collect()} == {
        (a, b, lev(a, b)) for a in ("hous", "mosue") for b in ("house", "mouse", "at") if lev(a, b) <= 3}


def _tables(spark, path, docs, items):
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


def test_spelling_queries_store_no_positions(spark, tmp_path, monkeypatch):
    """Positions (six columns a word) were checkpointed; context, ranking and rewriting against plain Python."""
    from sift.plans.queries import QUERIES
    texts = ["the house near horse runs"] * 12 + ["x big hoose near horse", "x HORZE runs  near mouze", None, "the hoose near"]
    _tables(spark, tmp_path, [(i, t, "en", "src1") for i, t in enumerate(texts)], [(1, "house horse near runs the big")])

    def no(df):
        raise AssertionError("the whole token table is checkpointed")
    monkeypatch.setattr("sift.session.cut_lineage", no)
    got = {(r.doc_id, r.pos): (r.token, r.correction, r.distance, r.context) for r in QUERIES["spelling_corrections"](spark, str(tmp_path)).collect()}
    assert got == {(12, 2): ("hoose", "house", 1, 12), (13, 1): ("HORZE", "HORSE", 1, 12), (13, 5): ("mouze", "house", 2, 0), (15, 1): ("hoose", "house", 1, 24)}
    report = {r.doc_id: r.corrected for r in QUERIES["spelling_report"](spark, str(tmp_path)).collect()}
    assert report == {12: "x big house near horse", 13: "x HORSE runs near house", 15: "the house near"}


def test_pooled_scores_store_document_terms_only(spark, tmp_path, monkeypatch):
    from sift.plans import queries
    _tables(spark, tmp_path, [(i, "green apples taste sweet" if i % 2 else "heavy trains arrive late", "en", "src3") for i in range(8)], [(1, "x")])

    def no(df):
        raise AssertionError("the whole token table is checkpointed")
    monkeypatch.setattr(queries, "cut_lineage", no)
    monkeypatch.setattr("sift.session.cut_lineage", no)
    rows = queries.QUERIES["topic_keywords_pooled"](spark, str(tmp_path)).collect()
    assert {r.token for r in rows if r.pool == "sum"} >= {"apples", "trains"} and {r.pool for r in rows} == {"max", "sum"}


def test_all_sizes_of_kmeans_share_their_passes(spark):
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F
    from sift.operators.cluster import kmeans_of_sizes, nearest_centres
    x = np.random.default_rng(4).normal(size=(400, 3))
    feats = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>").repartition(2).select(array_to_vector("v").alias("features")).persist()
    ks = list(range(2, 8))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sizes", "all sizes at once")
    got = kmeans_of_sizes(feats, ks, 40, 7)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # one pass an iteration for all sizes, where a fit of each takes one for every size
    assert len(tracker.getJobIdsForGroup("sizes")) <= 45
    for k in ks:
        model = KMeans(k=k, maxIter=40, seed=7).fit(feats)
        assert np.allclose(got[k], np.array(model.clusterCenters()), atol=1e-9)
    near = nearest_centres(feats, [got[k] for k in ks])
    want = model.transform(near).select(F.col("predictions")[len(ks) - 1].alias("p"), "prediction").collect()
    assert len(want) == 400 and all(r.p == r.prediction for r in want)
    feats.unpersist()


def test_models_of_few_rows_run_side_by_side(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    from sift.operators import cluster
    x = np.random.default_rng(5).normal(size=(300, 4))
    feats = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>").repartition(3).select(array_to_vector("v").alias("features")).persist()
    got = cluster.kmeans_of_sizes(feats, [2, 5, 7], 30, 7)
    monkeypatch.setattr(cluster, "FEW", 0)
    passes = cluster.kmeans_of_sizes(feats, [2, 5, 7], 30, 7)
    assert all(np.allclose(got[k], passes[k], atol=1e-9) and got[k].shape == (k, 4) for k in (2, 5, 7))
    # no pass of the rows an iteration
    monkeypatch.setattr(cluster, "FEW", 1 << 21)
    monkeypatch.setattr(cluster, "_sums", None)
    assert all(np.allclose(got[k], c) for k, c in cluster.kmeans_of_sizes(feats, [2, 5, 7], 30, 7).items())
    feats.unpersist()


def test_document_vectors_shuffle_no_vector_for_every_row(spark, monkeypatch):
    """Ids that repeat or are null, tokens without a vector or with two; sums of blocks against plain ones."""
    from pyspark.sql import functions as F
    from sift.operators import tokens as TK
    from sift.operators import vectors as V
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)]
    docs = [(i if i < 28 else 3 if i < 30 else None, i % 3 if i % 5 else None, [words[j] for j in rng.integers(0, 40, size=i)]) for i in range(32)] + [(99, 1, None)]
    table = spark.createDataFrame(docs, "doc_id long, cluster int, tokens array<string>").repartition(4)
    monkeypatch.setattr(TK, "BLOCK_TERMS", 30)
    terms = TK.terms_of_documents(table, keep=["cluster"])
    want = {}
    for d, c, t in docs:
        for w in t or []:
            want[(c, d, w)] = want.get((c, d, w), 0) + 1
    assert {(r.cluster, r.doc_id, r.token): r.m for r in terms.collect()} == want and terms.count() == len(want)
    assert terms.select("_b").distinct().count() > 4
    vec = {w: rng.normal(size=3) for w in words[:35]}
    rows = [(w, [float(x) for x in v]) for w, v in vec.items()] + [("w0", [1.0, 2.0, 3.0])]
    tv = spark.createDataFrame(rows, "token string, vec array<double>")
    made = V.mean_doc_vectors(terms, tv, keep=["cluster"])
    plan = made._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "mean" not in plan.split("== Physical Plan ==")[-1]
    got = {(r.cluster, r.doc_id): r.embedding for r in made.collect()}
    for key in {k[:2] for k in want}:
        found = [(m, np.array(v)) for (c, d, w), m in want.items() if (c, d) == key for t, v in rows if t == w]
        if found:
            assert np.allclose(got.pop(key), sum(m * v for m, v in found) / sum(m for m, _ in found))
    assert not got
    idf = spark.createDataFrame([(w, 0.1 * i) for i, w in enumerate(words)], "token string, idf double")
    long = TK.token_table(table.filter("doc_id < 28"))
    weighted = {r.doc_id: r.embedding for r in V.weighted_doc_vectors(long, idf, tv.filter(F.col("token") != "w0"), 0.5).collect()}
    for d, _, t in docs[1:28]:
        if d == 3:
            continue
        counts = {w: t.count(w) for w in t if w in vec and w != "w0"}
        if counts:
            total = sum(m * 0.5 / (0.5 + m * 0.1 * words.index(w)) * vec[w] for w, m in counts.items())
            assert np.allclose(weighted[d], total / sum(counts.values()))


def test_band_filter_shuffles_blocks_not_tokens(spark, monkeypatch):
    """Ids that repeat or are null, documents that become empty, blocks of a few documents."""
    from sift.operators import tokens as TK
    rng = np.random.default_rng(7)
    docs = [(i if i < 38 else 4 if i < 40 else None, [f"w{j}" for j in rng.zipf(1.5, size=9) if j < 60] or ["lone"]) for i in range(42)] + [(70, ["only"])]
    table = spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(3)
    long = TK.token_table(table)
    vocab = TK.frequency_band(TK.document_frequency(long, n_docs=len(docs)), 2, 40)
    kept = TK.regroup_tokens(TK.filter_tokens(long, vocab), "doc_id", "kept")
    want = sorted(((r.doc_id is None, r.doc_id or 0, r.kept or []) for r in table.select("doc_id").join(kept, "doc_id", "left").collect()), key=str)
    monkeypatch.setattr(TK, "BLOCK_TERMS", 40)
    made = TK.band_filtered(table, 2, 40)
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.kept) for r in made.collect()), key=str) == want
    assert "FlatMapCoGroupsInArrow" in made._jdf.queryExecution().toString() and any(w[2] for w in want) and not all(w[2] for w in want)
