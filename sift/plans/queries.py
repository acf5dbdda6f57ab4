"""Registered queries: one Spark plan per operator group of the survey.

Each query takes ``(spark, sf_dir)``, reads whole driver tables and returns a
DataFrame whose column names equal the matching oracle SQL in
:mod:`sift.plans.oracle`.  Doubles are rounded to 6 places and arrays are
rendered with ``array_join`` so that both engines print the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.functions import text as T
from sift.operators import tokens as TK
from sift.plans.tables import cluster_of_source, load
from sift.session import cut_lineage

QUERIES: dict = {}
#: between words of any script
NOT_LETTERS = r"[^\p{L}]+"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def keyword_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (doc_id, cluster, tokens) with F2 (at least one token)."""
    d = load(spark, sf_dir, "documents")
    return (d.select("doc_id", cluster_of_source().alias("cluster"), T.keyword_tokens("text").alias("tokens"))
             .filter(F.size("tokens") > 0))


@query
def topic_keywords_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: top-5 keyword label per group."""
    d = load(spark, sf_dir, "documents")
    # F2 (drop empty token lists) is implied: exploding an empty array emits no row.
    docs = d.select("doc_id", "source", T.keyword_tokens("text").alias("tokens"))
    long = TK.token_table(docs, keep=["source"])
    return TK.keyword_labels(long, ["source"], 5).select("source", "label")


# ------------------------------------------------------------ cleaning ---

@query
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T9 full cleaner (HTML, expansions, punctuation, stop words, T7/T8, T9)."""
    d = load(spark, sf_dir, "documents")
    toks = d.select("doc_id", T.clean_tokens("text").alias("tokens"))
    return toks.select("doc_id", F.size("tokens").alias("n_tokens"),
                       F.array_join("tokens", " ").alias("clean"))


@query
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 on raw pages."""
    p = load(spark, sf_dir, "pages")
    return p.select("page_id", T.strip_html("html").alias("text"))


# ------------------------------------------------------ text profiling ---

@query
def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T17-T22 per document: words, characters, stop words, punctuation,
    numeric and uppercase tokens."""
    from sift.functions import resources as R
    d = load(spark, sf_dir, "documents").select("doc_id", "text", T.split_words("text").alias("w"))
    w = F.col("w")
    return d.select(
        "doc_id",
        T.count_words_single_space("text").alias("n_words"),
        F.length("text").alias("n_chars"),
        T.count_if(w, lambda t: t.isin(list(R.STOP_WORDS))).alias("n_stop"),
        T.count_if(w, T.is_punct_token).alias("n_punct"),
        T.count_if(w, lambda t: t.rlike(T.NUMERIC)).alias("n_numeric"),
        T.count_if(w, T.is_all_upper).alias("n_upper"),
    )


@query
def caps_and_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7-F10 + A25: corpus counts and shares of the case/punctuation predicates."""
    d = load(spark, sf_dir, "documents")
    flags = d.select(
        T.is_all_upper("text").cast("int").alias("all_upper"),
        F.col("text").rlike(T.UPPER_RUN).cast("int").alias("upper_run"),
        F.col("text").rlike(T.ACRONYM).cast("int").alias("acronym"),
        F.col("text").rlike(T.PUNCT_RUN2).cast("int").alias("punct2"),
        F.col("text").rlike(T.PUNCT_RUN3).cast("int").alias("punct3"),
        (F.col("text").rlike(T.PUNCT_RUN3) & ~F.col("text").contains("...")).cast("int").alias("punct3_no_ellipsis"),
    )
    return flags.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("all_upper").cast("long").alias("n_all_upper"),
        F.round(F.avg("all_upper"), 6).alias("share_all_upper"),
        F.sum("upper_run").cast("long").alias("n_upper_run"),
        F.round(F.avg("upper_run"), 6).alias("share_upper_run"),
        F.sum("acronym").cast("long").alias("n_acronym"),
        F.sum("punct2").cast("long").alias("n_punct2"),
        F.sum("punct3").cast("long").alias("n_punct3"),
        F.sum("punct3_no_ellipsis").cast("long").alias("n_punct3_no_ellipsis"),
    )


@query
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments in exactly one of (all upper) and (upper run of 4+)."""
    d = load(spark, sf_dir, "documents")
    a = T.is_all_upper("text")
    b = F.col("text").rlike(T.UPPER_RUN)
    return d.filter(a != b).select("doc_id", a.alias("all_upper"), b.alias("upper_run"))


@query
def uppercase_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 + L8: the 35 most frequent all-uppercase whitespace tokens."""
    d = load(spark, sf_dir, "documents")
    toks = T.explode_nonempty(d, [], T.split_words("text"), "token").filter(T.is_all_upper("token"))
    return (toks.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
                .orderBy(F.desc("cnt"), F.asc("token")).limit(35))


@query
def seed_word_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 + F11: per (group, question) the comments holding a seed word, with hit counts."""
    from sift.functions import resources as R
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", T.tokenize(T.remove_punctuation("text")).alias("t"))
    pos, neg = F.array(*[F.lit(w) for w in R.CORPUS_POSITIVE_SEEDS]), F.array(*[F.lit(w) for w in R.CORPUS_NEGATIVE_SEEDS])
    hits = d.select("doc_id", "source", "lang",
                    F.size(F.filter("t", lambda x: F.array_contains(pos, x))).alias("pos_hits"),
                    F.size(F.filter("t", lambda x: F.array_contains(neg, x))).alias("neg_hits"))
    return hits.filter((F.col("pos_hits") > 0) | (F.col("neg_hits") > 0))


@query
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T15 + T26 + D4: one row per sentence, lowercased, bullet removed."""
    d = load(spark, sf_dir, "documents")
    s = d.select("doc_id", "lang", T.split_sentences(T.remove_chars(F.lower("text"), "•")).alias("s"))
    return T.explode_nonempty(s, ["doc_id", "lang"], "s", "sentence", "sent_no")


@query
def conversation_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T15 on the second text source, keyed by (conversation, turn)."""
    c = load(spark, sf_dir, "conversations")
    s = c.select("conv_id", "turn", "role", T.split_sentences(F.lower("text")).alias("s"))
    return T.explode_nonempty(s, ["conv_id", "turn", "role"], "s", "sentence", "sent_no")


@query
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus counts of keyword-token trigrams."""
    d = load(spark, sf_dir, "documents")
    g = T.explode_nonempty(d, [], T.ngrams(T.keyword_tokens("text"), 3), "ngram")
    return g.groupBy("ngram").agg(F.count(F.lit(1)).alias("cnt"))


@query
def phrase_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of adjacent capitalised tokens merged into phrases, distinct per document."""
    from sift.operators.chunks import continuous_chunks
    d = load(spark, sf_dir, "documents")
    long = T.explode_nonempty(d, ["doc_id"], T.split_words(T.remove_punctuation("text")), "token", "pos")
    return continuous_chunks(long, F.col("token").rlike(T.CAPITALISED))


# ------------------------------------------------------- vocabulary stats ---

def _keyword_long(spark, sf_dir, with_cluster=False):
    d = load(spark, sf_dir, "documents")
    cols = ["doc_id"] + ([cluster_of_source().alias("cluster")] if with_cluster else [])
    docs = d.select(*cols, T.keyword_tokens("text").alias("tokens"))
    keep = ["cluster"] if with_cluster else []
    return docs, TK.token_table(docs, keep=keep)


@query
def document_frequency_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: document frequency and ln(N/df) over the cleaned comments."""
    docs, long = _keyword_long(spark, sf_dir)
    n = docs.filter(F.size("tokens") > 0).count()
    dft = TK.document_frequency(long, n_docs=n)
    return dft.select("token", "df", "n_docs", F.round("idf", 6).alias("idf"))


@query
def frequency_band_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: keep tokens with 2 <= df <= floor(15% of N); documents may become empty."""
    docs, _ = _keyword_long(spark, sf_dir)
    out = TK.band_filtered(docs.filter(F.size("tokens") > 0), 2, 15)
    return out.select("doc_id", F.size("kept").alias("n_kept"), F.array_join("kept", " ").alias("kept"))


@query
def topic_keywords_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 + A5 + L1: per-cluster tf-idf keywords, top 10 by score."""
    _, long = _keyword_long(spark, sf_dir, with_cluster=True)
    ranked = TK.rank_keywords(TK.tfidf_scores(long, "cluster", max_features=5000), "cluster", 10)
    return ranked.select("cluster", "token", F.round("score", 6).alias("score"), "rank")


@query
def topic_keywords_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: per-cluster tf-idf keywords, top 10 by the largest and by the summed value over documents."""
    docs, _ = _keyword_long(spark, sf_dir, with_cluster=True)
    terms = TK.terms_of_documents(docs, keep=["cluster"])
    ranked = [TK.rank_keywords(TK.tfidf_scores(terms, "cluster", pool=p), "cluster", 10).select(F.lit(p).alias("pool"), "cluster", "token", "score", "rank")
              for p in ("max", "sum")]
    return ranked[0].unionByName(ranked[1]).withColumn("score", F.round("score", 6))


@query
def corpus_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus tf, row-based idf and tf*idf on the raw single-space split."""
    d = load(spark, sf_dir, "documents")
    r = TK.corpus_tfidf(d.select("doc_id", "text"))
    return r.select("token", "tf", "n_rows", F.round("idf", 6).alias("idf"), F.round("tfidf", 6).alias("tfidf"))


@query
def token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T24 + W6 + L10: frequency-ranked ids (cap 20000, OOV = 1), last 30, right-padded."""
    docs, _ = _keyword_long(spark, sf_dir)
    docs = cut_lineage(docs)
    vocab = TK.vocabulary_ids(TK.token_table(docs), 20000)
    seq = TK.token_sequences(docs, vocab, "tokens", "doc_id", 30)
    return seq.select("doc_id", F.array_join(F.col("seq").cast("array<string>"), " ").alias("seq"))


@query
def representative_statistical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 + W3: three comments per cluster with the highest relative-frequency weight."""
    _, long = _keyword_long(spark, sf_dir, with_cluster=True)
    r = TK.representative_statistical(long, "cluster", "doc_id", 3)
    return r.select("cluster", "doc_id", F.round("weight", 6).alias("weight"), "rank")


# ---------------------------------------------------------------- vectors ---

def _emb(spark, sf_dir):
    return load(spark, sf_dir, "embeddings")


@query
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 + A10: mean vector per cluster label (noise would count as a cluster)."""
    from sift.operators import vectors as V
    c = V.group_mean(_emb(spark, sf_dir), ["label"], "embedding", "centroid")
    return c.select("label", V.array_string("centroid").alias("centroid"))


@query
def representative_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vectors per cluster nearest (cosine) to the centroid."""
    from sift.operators import vectors as V
    r = V.representative_by_embedding(_emb(spark, sf_dir), "label", "vec_id", "embedding", 3)
    return r.select("label", "vec_id", F.round("dist", 6).alias("dist"), "rank")


@query
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-dimension min-max scaling to [0, 1], constant dimensions -> 0."""
    from sift.operators import vectors as V
    s = V.minmax_scale(_emb(spark, sf_dir), "embedding", "scaled")
    return s.select("vec_id", V.array_string("scaled").alias("scaled"))


def _doc_vectors(spark, sf_dir):
    """Keyword docs, their long table, stand-in token vectors and mean doc vectors."""
    from sift.operators import vectors as V
    docs, _ = _keyword_long(spark, sf_dir, with_cluster=True)
    terms = TK.terms_of_documents(docs, keep=["cluster"])
    tv = V.toy_token_vectors(terms.select("token"), 8)
    dv = V.mean_doc_vectors(terms, tv, "doc_id", keep=["cluster"])
    return docs, terms, tv, dv


@query
def weighted_document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 + J2 + J3: smooth-inverse-frequency weighted comment vectors."""
    from sift.operators import vectors as V
    docs, _ = _keyword_long(spark, sf_dir)
    terms = TK.terms_of_documents(docs)
    idf = TK.idf_from_terms(terms)
    tv = V.toy_token_vectors(terms.select("token"), 8)
    w = V.weighted_doc_vectors(terms, idf, tv, 1e-3)
    return w.select("doc_id", V.array_string("embedding").alias("embedding"))


@query
def mean_document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 + J2: plain mean token vector per comment."""
    from sift.operators import vectors as V
    _, _, _, dv = _doc_vectors(spark, sf_dir)
    return dv.select("doc_id", "cluster", V.array_string("embedding").alias("embedding"))


@query
def cluster_titles_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 + M14: title = corpus token nearest to the cluster's mean comment vector."""
    from sift.operators import vectors as V
    _, _, tv, dv = _doc_vectors(spark, sf_dir)
    cents = V.group_mean(dv, ["cluster"], "embedding", "centroid")
    t = V.nearest_token_per_centroid(tv, cents, "cluster", 8)
    return t.select("cluster", F.col("token").alias("title"), F.round("dist", 6).alias("dist"))


@query
def cluster_titles_multiplicative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15 + J12 + A26: 3CosMul titles from own vs other clusters' top-5 keywords."""
    from sift.operators import vectors as V
    _, long = _keyword_long(spark, sf_dir, with_cluster=True)
    counts = cut_lineage(TK.token_counts(long, ["cluster"]))
    tv = V.toy_token_vectors(counts.select("token"), 8)
    kw = TK.top_tokens(counts, ["cluster"], 5).select("cluster", "token")
    t = V.cosmul_titles(tv, kw, "cluster", 8, 3)
    return t.select("cluster", "token", "rank")


@query
def cluster_titles_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15 (first form): titles from a cluster's own top-5 keywords alone."""
    from sift.operators import vectors as V
    _, long = _keyword_long(spark, sf_dir, with_cluster=True)
    counts = cut_lineage(TK.token_counts(long, ["cluster"]))
    tv = V.toy_token_vectors(counts.select("token"), 8)
    kw = TK.top_tokens(counts, ["cluster"], 5).select("cluster", "token")
    return V.cosmul_titles(tv, kw, "cluster", 8, 3, negatives=False).select("cluster", "token", "rank")


@query
def topic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cluster keywords, top-5 label and the three most central comments."""
    from sift.operators import vectors as V
    from sift.operators.topn import ordered_list
    from sift.session import stored
    _, long, _, dv = _doc_vectors(spark, sf_dir)
    kw = TK.keyword_labels(long, ["cluster"], 5)
    rep = V.representative_by_embedding(stored(dv), "cluster", "doc_id", "embedding", 3)
    sent = ordered_list(rep, ["cluster"], "rank", "doc_id", "sentence_ids")
    return (kw.join(sent, "cluster", "left")
              .select("cluster", F.array_join("keywords", " ").alias("keywords"), "label",
                      F.array_join(F.col("sentence_ids").cast("array<string>"), " ").alias("sentence_ids")))


# ------------------------------------------------- neighbours and clusters ---

@query
def approximate_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, approximate mode: ten neighbours per vector from signed-projection buckets, measured exactly."""
    from sift.operators.approximate import approximate_knn
    return approximate_knn(_emb(spark, sf_dir), "vec_id", "embedding", 10).select("q", "s", F.round("dist", 6).alias("dist"), "rank")


@query
def approximate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the approximate mode, every 20th vector against all vectors."""
    from sift.operators.approximate import approximate_knn, recall
    emb = _emb(spark, sf_dir)
    found = approximate_knn(emb, "vec_id", "embedding", 10)
    return recall(found, emb, "vec_id", "embedding", 10, F.col("vec_id") % 20 == 0).select("n_queries", F.round("recall", 6).alias("recall"))


@query
def knn_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 10 nearest neighbours (Euclidean) of every vector."""
    from sift.operators.neighbors import knn
    r = knn(_emb(spark, sf_dir), "vec_id", "embedding", 10)
    return r.select(F.col("q").alias("vec_id"), F.col("s").alias("neighbor_id"),
                    F.round("dist", 6).alias("dist"), "rank")


@query
def local_outlier_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 + W9 + F15: LOF (k=20) and the inlier flag at 15% contamination."""
    from sift.operators.neighbors import local_outlier_factor as lof
    r = lof(_emb(spark, sf_dir), "vec_id", "embedding", 20, 0.15)
    return r.select("vec_id", F.round("lof", 6).alias("lof"), "is_inlier")


@query
def single_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5d + J9: single-linkage clusters below cosine distance 0.62."""
    from sift.operators.cluster import single_linkage as sl
    return sl(_emb(spark, sf_dir), "vec_id", "embedding", 0.62)


@query
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters at Euclidean radius 1.12, 2 samples, clusters of 4+."""
    from sift.operators.cluster import density_clusters as dc
    return dc(_emb(spark, sf_dir), "vec_id", "embedding", 1.12, 2, 4)


@query
def cosine_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18 + X7: mean cosine silhouette of the given labels (linear cluster-sum form)."""
    from sift.operators.cluster import silhouette
    s = silhouette(_emb(spark, sf_dir), "embedding", "label", "cosine")
    return spark.createDataFrame([(round(s, 6),)], "silhouette double")


@query
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 + A11 + L7: cluster count, noise count and size range of the labels."""
    from sift.operators.cluster import cluster_stats
    return cluster_stats(_emb(spark, sf_dir).select(F.col("label").alias("cluster")))


# -------------------------------------------------------------- ML models ---

@query
def kmeans_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-means (k=10, 100 iterations, seed 42) on the comment vectors."""
    from sift.operators.cluster import kmeans
    return kmeans(_emb(spark, sf_dir), "vec_id", "embedding", 10, 100, 42)


@query
def bisecting_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5e: fixed-k hierarchical (bisecting k-means) clusters."""
    from sift.operators.cluster import kmeans
    return kmeans(_emb(spark, sf_dir), "vec_id", "embedding", 10, 100, 42, bisecting=True)


def _two_components(spark, sf_dir):
    """Unit vectors in their first two principal components (the neighbour grid prunes there)."""
    from sift.operators.reduce import normalise_step, reduce_step
    return reduce_step(normalise_step(_emb(spark, sf_dir).select("vec_id", "embedding")), 2)


@query
def density_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of greatest stability in the hierarchy of densities of the reduced vectors."""
    from sift.operators.hierarchy import density_hierarchy as dh
    return dh(_two_components(spark, sf_dir), "vec_id", "embedding", min_cluster_size=10, min_samples=5)


@query
def ward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5e: ten clusters by Ward linkage of the reduced vectors."""
    from sift.operators.reduce import merge_step
    return merge_step(_two_components(spark, sf_dir), "ward", n_clusters=10).select("vec_id", "cluster")


@query
def average_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5e: average linkage (cosine) of the vectors, cut at 0.55."""
    from sift.operators.reduce import merge_step
    return merge_step(_emb(spark, sf_dir).select("vec_id", "embedding"), "average", 0.55).select("vec_id", "cluster")


@query
def complete_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5e: complete linkage (Euclidean) of the reduced vectors, cut at 0.1."""
    from sift.operators.reduce import merge_step
    return merge_step(_two_components(spark, sf_dir), "complete", 0.1, affinity="euclidean").select("vec_id", "cluster")


@query
def best_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L9 + A19: silhouette (squared Euclidean) for k = 5..20 with k-means; best flagged.

    The feature column is built and cached once; one pass over it is an iteration of the models of
    all k (``kmeans_of_sizes``).
    """
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    from sift.operators.cluster import kmeans_of_sizes, nearest_centres
    feats = _emb(spark, sf_dir).select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).persist()
    ks = list(range(5, 21))
    centres = kmeans_of_sizes(feats, ks, 100, 42)
    near = nearest_centres(feats, [centres[k] for k in ks]).persist()
    ev = ClusteringEvaluator(distanceMeasure="squaredEuclidean")

    def score(at):
        return ks[at], float(ev.evaluate(near.select("features", F.col("predictions")[at].alias("prediction"))))
    # the scores of the models run as concurrent Spark jobs (as CrossValidator's parallelism does)
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=4) as pool:
        rows = list(pool.map(score, range(len(ks))))
    near.unpersist()
    feats.unpersist()
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    return spark.createDataFrame([(k, round(s, 6), k == best) for k, s in rows],
                                 "k int, silhouette double, is_best boolean")


@query
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 + A17 + W7: centred PCA to min(150, d) components; cumulative explained variance."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import Window
    e = _emb(spark, sf_dir).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    d = len(e.first()["x"])
    centred = StandardScaler(withMean=True, withStd=False, inputCol="x", outputCol="c").fit(e).transform(e)
    model = PCA(k=min(150, d), inputCol="c", outputCol="p").fit(centred)
    ev = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance.toArray())]
    df = spark.createDataFrame(ev, "component int, ratio double")
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum("ratio").over(w))


@query
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 (re-aimed): 2-D layout = PCA(2) of the centred unit vectors -> PC1, PC2."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from sift.operators.neighbors import unit
    e = _emb(spark, sf_dir).select("vec_id", array_to_vector(unit(F.col("embedding").cast("array<double>"))).alias("x"))
    c = StandardScaler(withMean=True, withStd=False, inputCol="x", outputCol="c").fit(e).transform(e)
    p = PCA(k=2, inputCol="c", outputCol="p").fit(c).transform(c)
    a = vector_to_array("p")
    return p.select("vec_id", a[0].alias("PC1"), a[1].alias("PC2"))


@query
def topic_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 + M8 + M6: normalise -> PCA(10) -> k-means(10, 100 iterations) -> LOF on the reduced vectors."""
    from sift.operators.reduce import topic_pipeline as tp
    r = tp(_emb(spark, sf_dir).select("vec_id", "embedding"), "kmeans", 10, {"k": 10})
    return r.select("vec_id", "cluster", F.round("lof", 6).alias("lof"), "is_inlier")


@query
def topic_pipeline_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 in density mode on two principal components (grid cells prune there), LOF per label."""
    from sift.operators.reduce import topic_pipeline as tp
    r = tp(_emb(spark, sf_dir).select("vec_id", "embedding", "label"), "density", 2,
           {"eps": 0.05, "min_samples": 3, "min_cluster_size": 5}, {"group_col": "label"})
    return r.select("vec_id", "label", "cluster", F.round("lof", 6).alias("lof"), "is_inlier")


def _stored_runs(spark, sf_dir, grids):
    """Run the grids ``(mode, step, grid)`` one by one, append each to a run table in the shared folder, read it back."""
    import uuid
    from sift.operators import reduce as RD
    from sift.operators import runs as RN
    from sift.operators.cluster import cluster_stats, silhouette
    from sift.session import checkpoint_dir
    from sift.sources import readers, sinks
    emb = cut_lineage(_emb(spark, sf_dir).select("vec_id", "embedding"))
    raw = emb.select("vec_id", F.col("embedding").alias("raw"))

    def evaluate(df):
        labelled = cut_lineage(df.select("vec_id", "cluster").join(raw, "vec_id"))  # scored on the unreduced vectors
        st = cluster_stats(labelled).first()
        score = round(silhouette(labelled, "raw", "cluster", "cosine"), 6) if st["n_clusters"] > 1 else None
        return score, int(st["n_clusters"]), int(st["n_outliers"])
    path = f"{checkpoint_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    for mode, step, grid in grids:
        steps = {"normalise": RD.normalise_step, "reduce": RD.reduce_step, "cluster": step}
        next_id = RN.next_grid_id(readers.read_runs(spark, path)).first()[0]
        sinks.append_runs(RN.run_grid(spark, emb, "vec_id", "embedding", RN.build_grid(grid), steps, evaluate, next_id, mode), path)
    return readers.read_runs(spark, path)


def _kmeans_grid():
    from sift.operators.reduce import kmeans_step
    return [("kmeans", kmeans_step, {"normalise": {"on": [False, True]}, "reduce": {"k": [2, 10]}, "cluster": {"k": [8, 10, 12]}})]


def _cluster_grids():
    """A grid of the density hierarchy, and one of the linkages, on two components."""
    from sift.operators.reduce import hierarchy_step, merge_step
    shared = {"normalise": {"on": [True]}, "reduce": {"k": [2]}}
    return [("hierarchy", hierarchy_step, shared | {"cluster": {"min_cluster_size": [10, 30], "min_samples": [5]}}),
            ("merge", merge_step, shared | {"cluster": {"linkage": ["ward", "average"], "n_clusters": [10]}}),
            ("merge", merge_step, shared | {"cluster": {"linkage": ["complete"], "threshold": [0.1], "affinity": ["euclidean"]}})]


@query
def grid_search_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 + M10 + K5: grid (normalise x PCA to 2 or 10 x k in 8, 10, 12) scored by cosine silhouette
    on the unreduced vectors; one run-table row per node, as stored."""
    return _stored_runs(spark, sf_dir, _kmeans_grid()).select("grid_id", "node", "mode", F.to_json("parameters").alias("parameters"),
                                                              "silhouette", "n_clusters", "n_outliers")


@query
def grid_search_clusterings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 + X3: grids of the density hierarchy and of Ward, average and complete linkage, as stored, each grid's best node flagged."""
    from sift.operators.runs import best_config as bc
    runs = _stored_runs(spark, sf_dir, _cluster_grids())
    best = bc(runs).select("mode", "grid_id", F.col("best_node").alias("node"), F.lit(True).alias("is_best"))
    return (runs.join(best, ["mode", "grid_id", "node"], "left")
            .select("grid_id", "node", "mode", F.to_json("parameters").alias("parameters"), "silhouette", "n_clusters", "n_outliers",
                    F.coalesce("is_best", F.lit(False)).alias("is_best")))


@query
def grid_best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24 + L6 over a run table that the grid search wrote: its best node, with the parameters."""
    from sift.operators.runs import best_config as bc
    runs = _stored_runs(spark, sf_dir, _kmeans_grid())
    best = bc(runs)
    return best.join(runs.select("mode", "grid_id", F.col("node").alias("best_node"), F.to_json("parameters").alias("parameters")),
                     ["mode", "grid_id", "best_node"])


def _runs_from_embeddings(spark, sf_dir):
    """A run table derived from the vector table: node = vector, grid = label,
    mode by label half, score = first coordinate (null when it is negative)."""
    e = _emb(spark, sf_dir)
    score = F.col("embedding")[0].cast("double")
    return e.select(F.col("label").alias("grid_id"), F.col("vec_id").alias("node"),
                    F.when(F.col("label") < 5, "kmeans").otherwise("hdbscan").alias("mode"),
                    F.when(score >= 0, score).alias("silhouette"))


@query
def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24 + L6: best node per (mode, grid id), nulls skipped, first inserted wins ties."""
    from sift.operators.runs import best_config as bc
    r = bc(_runs_from_embeddings(spark, sf_dir))
    return r.select("mode", "grid_id", "best_node", F.round("best_score", 6).alias("best_score"))


@query
def next_grid_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next grid id of a run table."""
    from sift.operators.runs import next_grid_id as ng
    return ng(_runs_from_embeddings(spark, sf_dir))


# -------------------------------------------------------------- sentiment ---

def _sentiment_docs(spark, sf_dir, labels=None, store=lambda docs: docs):
    """Comments cleaned for sentiment: HTML, expansions, punctuation, T7/T8, T9 (stop words kept); with ``labels`` only theirs."""
    from sift.functions import resources as R
    from sift.operators import sentiment as S
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    if labels is not None:
        d = d.join(labels, "doc_id", "left_semi")
    docs = store(d.select("doc_id", T.clean_tokens("text", T.CleanOptions(stopwords=False)).alias("tokens")))
    return docs, S.lexicon_features(docs, S.lexicon_frame(spark, R.LEXICON + R.CORPUS_LEXICON))


@query
def lexicon_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15 + J4 + W8: lexicon sums and shares per comment."""
    _, f = _sentiment_docs(spark, sf_dir)
    return f.select("doc_id", *[F.round(c, 6).alias(c) for c in ["neg_sum", "pos_sum", "neg_share", "pos_share"]])


@query
def lexicon_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-based three-class sentiment from the lexicon sums."""
    from sift.operators import sentiment as S
    _, f = _sentiment_docs(spark, sf_dir)
    return S.lexicon_sentiment(f)


def _labelled(spark, sf_dir, all_comments=True):
    """Comments with their features, label (if any) and split: of all comments or of the labelled ones."""
    from sift.operators import sentiment as S
    from sift.session import stored
    lab = load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).alias("y"))
    # cleaned once, read by the features, the lengths and the fit
    docs, feats = _sentiment_docs(spark, sf_dir, None if all_comments else lab.filter(F.col("y").isNotNull()), stored)
    data = docs.join(feats, "doc_id").join(lab, "doc_id", "left") \
               .withColumn("label", (F.col("y") + 1).cast("double")) \
               .withColumn("split", S.split_column("doc_id"))
    # materialise once: feature extraction and the iterative fit reuse it
    return stored(data)


@query
def train_predict_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 + M12 + L5: train on the labelled 90 % split, predict every comment."""
    from sift.operators import sentiment as S
    data = _labelled(spark, sf_dir)
    model = S.train(data.filter((F.col("split") == "train") & F.col("label").isNotNull()))
    return model.transform(data).select("doc_id", (F.col("prediction") - 1).cast("int").alias("sentiment"), "split", "y")


@query
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21 + A22: actual vs predicted class counts, accuracy and loss (mean cross-entropy) on the 10 % hold-out."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from sift.operators import sentiment as S
    data = _labelled(spark, sf_dir, all_comments=False).filter(F.col("label").isNotNull())
    model = S.train(data.filter(F.col("split") == "train"))
    test = cut_lineage(model.transform(data.filter(F.col("split") == "test")).select("label", "prediction", "probability"))
    acc = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(test)
    loss = MulticlassClassificationEvaluator(metricName="logLoss").evaluate(test)
    actual = test.groupBy((F.col("label") - 1).cast("int").alias("sentiment")).agg(F.count(F.lit(1)).alias("n_actual"))
    pred = test.groupBy((F.col("prediction") - 1).cast("int").alias("sentiment")).agg(F.count(F.lit(1)).alias("n_predicted"))
    classes = spark.createDataFrame([(-1,), (0,), (1,)], "sentiment int")
    return (classes.join(actual, "sentiment", "left").join(pred, "sentiment", "left")
                   .select("sentiment", F.coalesce("n_actual", F.lit(0)).alias("n_actual"),
                           F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"),
                           F.lit(round(acc, 6)).alias("accuracy"), F.lit(round(loss, 6)).alias("loss")))


# --------------------------------------------------------------- spelling ---

def _spelling_base(spark, sf_dir):
    from sift.operators import spelling as SP
    from sift.session import stored
    # positions are many times the texts, so each of their consumers (frequency, errors, bigrams) makes them
    # from the texts again; the vocabulary is stored
    pos = SP.positions(load(spark, sf_dir, "documents"))
    freq = stored(SP.corpus_frequency(pos))
    bench = SP.positions(load(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"))
    dictionary = stored(bench.select(F.col("clean").alias("word")).filter(F.col("word") != "").distinct())
    errors = SP.detect_errors(pos, freq, dictionary, 10)
    # candidates: frequent corpus words that are also in the dictionary (bounded by the dictionary)
    words = stored(dictionary.join(freq.filter(F.col("freq") > 10).select(F.col("clean").alias("word")), "word", "left_semi"))
    return SP, pos, freq, errors, words


@query
def spelling_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 + C2 + T13 + A14: detected spelling errors by position."""
    _, _, _, errors, _ = _spelling_base(spark, sf_dir)
    return errors.select("doc_id", "pos", "token", "clean")


@query
def spelling_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11 + C3 + T23: dictionary/frequent words within edit distance 3 of each error word."""
    SP, _, _, errors, words = _spelling_base(spark, sf_dir)
    q = errors.select(F.col("clean").alias("query")).distinct()
    return SP.candidate_pairs(q, words, 3).select("query", "word", "distance")


@query
def spelling_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 + C5 + C6: chosen correction per error position (context = corpus bigrams)."""
    return _corrections(spark, sf_dir)


def _corrections(spark, sf_dir):
    from sift.session import stored
    SP, pos, freq, errors, words = _spelling_base(spark, sf_dir)
    errors = stored(errors.select("doc_id", "pos", "token", "clean", "prev", "next"))
    q = errors.select(F.col("clean").alias("query")).distinct()
    cands = SP.candidate_pairs(q, words, 3)
    return SP.choose_corrections(errors, cands, SP.bigram_counts(pos, words=words), freq)


@query
def spelling_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: (original, corrected) text of every comment the corrector changed."""
    from sift.operators import spelling as SP
    return SP.rewrite(load(spark, sf_dir, "documents"), _corrections(spark, sf_dir))


# ------------------------------------------------------ more text operators ---

@query
def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T31 + F14 + L3: labelled comments (label = quality - toxic, nulls dropped)
    cleaned with HTML stripping, whole-token expansions (case-insensitive) and
    single-character removal; every row is cleaned (no early return)."""
    from sift.functions import resources as R
    d = load(spark, sf_dir, "documents")
    lab = load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).cast("string").alias("label"))
    j = TK.first_n_documents(d.join(lab, "doc_id").filter(F.col("label").isNotNull()), None)
    toks = T.split_words(T.strip_html("text"))
    toks = T.expand_tokens(T.expand_tokens(toks, R.CONTRACTIONS, True), R.ABBREVIATIONS, True)
    return j.select("doc_id", "label", F.array_join(T.drop_short_tokens(toks, 2), " ").alias("text"))


@query
def rows_per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments per question (language stands in for the question)."""
    return load(spark, sf_dir, "documents").groupBy(F.col("lang").alias("question")) \
                                           .agg(F.count(F.lit(1)).alias("n_comments"))


@query
def first_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5 + F12: first three comments per cluster by id; noise (-1, here documents without a source) is dropped."""
    from sift.operators.topn import top_n_per_group
    d = load(spark, sf_dir, "documents").select("doc_id", F.coalesce(cluster_of_source(), F.lit(-1)).alias("cluster"))
    d = d.filter(F.col("cluster") != -1)
    return top_n_per_group(d, ["cluster"], [F.asc("doc_id")], 3).select("cluster", "doc_id", "rank")


@query
def lemmatized_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plural rules applied once per distinct token, joined back, regrouped per comment."""
    docs, long = _keyword_long(spark, sf_dir)
    lem = TK.lemma_table(long, lambda t: T.lemmatize_rules(F.array(t))[0])
    out = TK.regroup_tokens(TK.lemmatize_with_table(long, lem), "doc_id", "lemmas")
    return out.select("doc_id", F.array_join("lemmas", " ").alias("lemmas"))


@query
def noun_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M17 + E6 + J10: per cluster the ten nouns (by suffix rule) shared by most comment pairs."""
    docs, _ = _keyword_long(spark, sf_dir, with_cluster=True)
    r = TK.noun_keywords(docs, lambda t: t.rlike(T.NOUN_SUFFIX), "cluster", "doc_id", "tokens", 10)
    return r.select("cluster", "token", "pairs", "rank")


@query
def keyword_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-3 keyword label per (question, cluster), the clusters of the table pivoted into columns."""
    d = load(spark, sf_dir, "documents")
    docs = d.select("doc_id", F.col("lang").alias("question"), cluster_of_source().alias("cluster"),
                    T.keyword_tokens("text").alias("tokens"))
    long = TK.token_table(docs, keep=["question", "cluster"])
    lab = TK.keyword_labels(long, ["question", "cluster"], 3)
    clusters = [r.cluster for r in d.select(cluster_of_source().alias("cluster")).distinct().orderBy("cluster").collect()]
    return lab.groupBy("question").pivot("cluster", clusters).agg(F.first("label"))


@query
def sentence_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T15 + J6 + A8 + F13: per sentence the mean vector of its words found in the
    word list (benchmark vocabulary); sentences with fewer than 2 such words dropped."""
    from sift.operators import vectors as V
    d = load(spark, sf_dir, "documents")
    s = T.explode_nonempty(d, ["doc_id"], T.split_sentences(T.remove_chars(F.lower("text"), "•")), "sentence", "sent_no")
    long = T.explode_nonempty(s, ["doc_id", "sent_no"], F.split("sentence", NOT_LETTERS), "token").filter(F.col("token") != "")
    b = load(spark, sf_dir, "benchmark")
    wl = T.explode_nonempty(b, [], F.split(F.lower("text"), NOT_LETTERS), "token").filter(F.col("token") != "").distinct()
    tv = V.toy_token_vectors(wl, 8)
    sv = V.sentence_vectors(long, wl, tv, ["doc_id", "sent_no"], 2)
    return sv.select("doc_id", "sent_no", "n_valid", V.array_string("embedding").alias("embedding"))


@query
def vocabulary_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean stand-in vector over the corpus words that are in the benchmark word list."""
    from sift.operators import vectors as V
    _, long = _keyword_long(spark, sf_dir)
    tv = V.toy_token_vectors(long.select("token"), 8)
    b = load(spark, sf_dir, "benchmark")
    wl = T.explode_nonempty(b, [], F.split(F.lower("text"), NOT_LETTERS), "token").filter(F.col("token") != "")
    m = V.vocabulary_mean(tv, wl)
    return m.select("n_words", V.array_string("mean").alias("mean"))


@query
def lof_per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: LOF (k=20, 15 %) of the mean comment vectors inside each question (language)."""
    from sift.operators.neighbors import local_outlier_factor_by_group
    _, _, _, dv = _doc_vectors(spark, sf_dir)
    lang = load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("question"))
    pts = dv.join(lang, "doc_id").select("doc_id", "question", "embedding")
    r = local_outlier_factor_by_group(pts, "question", "doc_id", "embedding", 20, 0.15)
    return r.select("question", "doc_id", F.round("lof", 6).alias("lof"), "is_inlier")


@query
def simple_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-by-word correction of every sentence (edit distance <= 2, ranked by distance, then frequency).

    Words are split at single spaces and only words are corrected: digits,
    punctuation and accented letters stay in the text."""
    from sift.operators import spelling as SP
    _, pos, freq, _, cands = _spelling_base(spark, sf_dir)
    bench = SP.positions(load(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"))
    dictionary = bench.select(F.col("clean").alias("word")).filter(F.col("word") != "").distinct()
    keep = dictionary.unionByName(freq.filter(F.col("freq") > 10).select(F.col("clean").alias("word"))).distinct()
    d = load(spark, sf_dir, "documents")
    s = T.explode_nonempty(d, ["doc_id"], T.split_sentences("text"), "sentence", "sent_no")
    w = T.explode_nonempty(s, ["doc_id", "sent_no"], F.split(F.lower("sentence"), " ", -1), "word", "pos")
    c = SP.simple_corrections(w, keep, cands, freq, 2)
    return c.select("doc_id", "sent_no", F.array_join("corrected", " ").alias("corrected"))


@query
def word2vec_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: 16-d vectors of all tokens, trained on the cleaned comments in five passes (Spark ML Word2Vec).

    The driver holds the vocabulary and its vectors (``train_word2vec``)."""
    from sift.operators import vectors as V
    docs, _ = _keyword_long(spark, sf_dir)
    return V.train_word2vec(docs, "tokens", 16, min_count=1, max_iter=5, seed=42)


@query
def stemmed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Porter stems computed once per distinct token, joined back, regrouped per comment."""
    from sift.functions.stem import stem_column
    _, long = _keyword_long(spark, sf_dir)
    stems = stem_column(long.select("token").distinct(), "token", "lemma")
    out = TK.regroup_tokens(TK.lemmatize_with_table(long, stems), "doc_id", "stems")
    return out.select("doc_id", F.array_join("stems", " ").alias("stems"))


@query
def class_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21 + L5: labelled comments per class in the training and the test split."""
    from sift.operators import sentiment as S
    lab = load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).alias("sentiment"))
    return (lab.withColumn("split", S.split_column("doc_id")).groupBy("split", "sentiment")
               .agg(F.count(F.lit(1)).alias("n_actual")))


@query
def comments_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """comments, non-empty comments and distinct texts per (group, question)."""
    d = load(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("report_grouping"), F.col("lang").alias("question")).agg(
        F.count(F.lit(1)).alias("n_comments"), F.sum((F.length("text") > 0).cast("long")).alias("n_filled"),
        F.countDistinct("text").alias("n_distinct"))


@query
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cluster the number of members and their ids in ascending order (as chunks of 100)."""
    from sift.operators.stats import positions
    e = positions(_emb(spark, sf_dir).select("label", "vec_id"), "label", "vec_id", "at")
    rows = e.withColumn("chunk", F.floor(F.col("at") / 100).cast("int"))
    return rows.groupBy("label", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("vec_id")).alias("ids")) \
               .select("label", "chunk", "n", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query
def silhouette_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouette (squared Euclidean) of every vector, from cluster sums."""
    from sift.operators.cluster import silhouette_samples as ss
    r = ss(_emb(spark, sf_dir), "vec_id", "embedding", "label")
    return r.select("vec_id", F.col("cluster").alias("label"), F.round("silhouette", 6).alias("silhouette"))


def _toy_annotations(spark, sf_dir):
    """A stand-in (token, pos, lemma) table over the corpus vocabulary: tags by suffix, lemmas by plural rules."""
    _, long = _keyword_long(spark, sf_dir)
    t = F.col("token")
    tag = F.when(t.rlike(T.NOUN_SUFFIX), "NOUN").when(t.endswith("ly"), "ADV").when(t.endswith("ing"), "VERB").otherwise("X")
    return long, long.select("token").distinct().select("token", tag.alias("pos_tag"), T.lemmatize_rules(F.array(t))[0].alias("lemma"))


@query
def normalised_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nouns to their lemma, adverbs dropped, all other tokens kept (a lexicon join on the token table)."""
    long, table = _toy_annotations(spark, sf_dir)
    out = TK.normalise_by_tag(long, table, lemma_tags=["NOUN"], drop_tags=["ADV"])
    return TK.regroup_tokens(out, "doc_id", "tokens").select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query
def annotation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 (token, tag, lemma) annotations of every comment."""
    long, table = _toy_annotations(spark, sf_dir)
    r = TK.annotations(long, table, 20)
    return r.select("doc_id", F.array_join(F.transform("annotations", lambda a: F.concat_ws("/", a["token"], a["pos_tag"], a["lemma"])), " ")
                    .alias("annotations"))


@query
def total_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 + W7: variance of the centred vectors, its share in the principal components together, and the number of them."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    e = _emb(spark, sf_dir).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    s = e.agg(Summarizer.variance(F.col("x")).alias("v"), F.max(F.size(vector_to_array("x"))).alias("d")).first()
    model = PCA(k=s["d"], inputCol="x", outputCol="p").fit(e)
    return spark.createDataFrame([(int(s["d"]), round(float(sum(s["v"])), 6), round(float(model.explainedVariance.toArray().sum()), 6))],
                                 "n_components int, variance double, explained double")
