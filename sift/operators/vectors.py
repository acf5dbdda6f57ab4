"""Vector table jobs: ``(id, embedding array<float|double>)``.

Per-row vector math stays in JVM higher-order functions (``zip_with``,
``aggregate``); per-group vector statistics use Spark ML's ``Summarizer``
(one vector buffer per group, partial aggregation before the shuffle, no
``d``-fold explode).  Small per-cluster tables (centroids, keyword vectors)
are checked against an explicit size bound before they are shipped to the
executors as literals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.operators.topn import top_n_per_group
from sift.session import importable, parallelism, spread

# Upper bound for a table that is inlined into an expression (rows x dims).
MAX_BROADCAST_ROWS = 50_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------ row math ---

def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double")),
                              F.lit(0.0), lambda acc, v: acc + v))


def cosine_distance(a, b) -> Column:
    """1 - a.b / (|a| |b|); 1 where one of them is a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.try_divide(dot(a, b), n))


def scale(a, s) -> Column:
    """Vector times scalar."""
    return F.transform(_c(a), lambda x: x.cast("double") * s)


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def round_array(a, places: int = 6) -> Column:
    return F.transform(_c(a), lambda x: F.round(x.cast("double"), places))


def array_string(a, places: int = 6) -> Column:
    """Render a vector as 'v1 v2 ...' with fixed decimals (for SQL comparison)."""
    fmt = f"%.{places}f"
    # moved off a tie before it is rounded (engines break ties differently); +0.0 lets -0.0 print as 0.000000
    off = 10.0 ** -(places + 4)
    return F.array_join(F.transform(_c(a), lambda x: F.format_string(fmt, F.round(x.cast("double") + F.lit(off), places) + 0.0)),
                        " ")


# -------------------------------------------------------- group statistics ---

def group_mean(df: DataFrame, group_cols: list[str], vec_col: str, out_col: str = "centroid",
               weight_col: str | None = None) -> DataFrame:
    """Per-group mean vector with Summarizer (noise label included as a group)."""
    v = array_to_vector(F.col(vec_col).cast("array<double>"))
    w = F.col(weight_col) if weight_col else None
    agg = Summarizer.mean(v, w) if w is not None else Summarizer.mean(v)
    return df.groupBy(*group_cols).agg(vector_to_array(agg).alias(out_col))


def group_sum(df: DataFrame, group_cols: list[str], vec_col: str, weight_col: str,
              out_col: str = "vsum") -> DataFrame:
    """Weighted vector sum per group: sum_i w_i * v_i."""
    v = array_to_vector(F.col(vec_col).cast("array<double>"))
    s = Summarizer.metrics("sum").summary(v, F.col(weight_col))
    return df.groupBy(*group_cols).agg(vector_to_array(s["sum"]).alias(out_col))


def minmax_scale(df: DataFrame, vec_col: str, out_col: str = "scaled", lo: float = 0.0,
                 hi: float = 1.0) -> DataFrame:
    """Per-dimension min-max scaling with Spark ML's MinMaxScaler.

    A constant dimension becomes ``lo`` (Spark's scaler would give the middle
    of the range).  The fitted minima/maxima are ``d`` numbers on the driver.
    """
    from pyspark.ml.feature import MinMaxScaler
    tmp = df.withColumn("_v", array_to_vector(F.col(vec_col).cast("array<double>")))
    model = MinMaxScaler(inputCol="_v", outputCol="_s", min=lo, max=hi).fit(tmp)
    mins, maxs = model.originalMin.toArray(), model.originalMax.toArray()
    const = F.array(*[F.lit(bool(a == b)) for a, b in zip(mins, maxs)])
    out = model.transform(tmp).withColumn(
        out_col, F.zip_with(vector_to_array("_s"), const, lambda x, c: F.when(c, F.lit(lo)).otherwise(x)))
    return out.drop("_v", "_s")


# --------------------------------------------------------- token vectors ---

def toy_token_vectors(vocab: DataFrame, dims: int = 8) -> DataFrame:
    """Deterministic stand-in token vectors from character codes (portable arithmetic).

    Dimension k of token t: ``((ascii(t[k mod len + 1]) * (k + 1)) mod 31) / 31 - 0.5``.
    Used where the reference loads pretrained vectors; a real table
    ``(token, vec)`` can be passed instead everywhere.
    """
    t = F.col("token")

    def dim(k):
        ch = t.substr(F.lit(k) % F.length(t) + 1, F.lit(1))
        return ((F.ascii(ch) * (k + 1)) % 31) / F.lit(31.0) - 0.5
    return vocab.select("token").distinct().select("token", F.array(*[dim(k) for k in range(dims)]).alias("vec"))


def _wrapped(batches):
    """Rows of ``(_b, ..)`` as compressed Arrow batches, one row for each block of a batch."""
    for batch in batches:
        blocks = batch.column("_b").to_numpy()
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        parts = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(a, b - a).drop_columns(["_b"])
            part = pa.RecordBatch.from_arrays([c.dictionary_encode() if pa.types.is_string(c.type) else c for c in part.columns], names=part.schema.names)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_batch(part)
            parts.append(sink.getvalue().to_pybytes())
        if len(blocks):
            yield pa.RecordBatch.from_arrays([pa.array(blocks[cuts[:-1]]), pa.array(parts, pa.binary())], names=["_b", "part"])


def _unwrapped(parts: pa.ChunkedArray, whole: bool = True):
    tables = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in parts]
    if not whole:
        return tables
    return pa.concat_tables(tables).unify_dictionaries().combine_chunks()


def _sums_of_blocks(terms: DataFrame, keys: list[str], words: DataFrame, weight) -> DataFrame:
    """``(keys.., vsum, wsum, n)`` of every document: the sum of ``w * vec`` over its rows of ``terms(keys.., token, m)`` whose token is in
    ``words(token, vec, ..)``, of ``w`` and of ``m``; ``weight(m, rows of words)`` gives ``w`` as NumPy.

    A block of documents gets each of its words once, so neither vectors nor sums are shuffled for every row; the rows
    themselves are shuffled as compressed batches."""
    from pyspark.sql.pandas.types import to_arrow_type
    from sift.operators.tokens import BLOCK_TERMS
    importable(terms.sparkSession)
    if "_b" not in terms.columns:
        blocks = max(1, -(-terms.count() // BLOCK_TERMS))
        terms = terms.withColumn("_b", F.pmod(F.xxhash64(keys[-1]), F.lit(blocks)).cast("bigint"))
    # keys that repeat lie in blocks of their own: a document is in one block
    need = terms.select("_b", "token").distinct().join(words.filter(F.col("vec").isNotNull()), "token")
    need = need.select(*[F.col(c).alias(f"_{c}") for c in need.columns])
    schema = ", ".join([*(f"{k} {terms.schema[k].dataType.simpleString()}" for k in keys), "vsum array<double>, wsum double, n bigint"])

    def run(l: pa.Table, m: pa.Table) -> pa.Table:
        l, m = _unwrapped(l.column("part")), m.combine_chunks()
        code = pc.dictionary_encode(m.column("_token").combine_chunks())
        token = l.column("token").combine_chunks()
        token = token.chunk(0) if isinstance(token, pa.ChunkedArray) else token
        at = pc.index_in(token.dictionary, value_set=code.dictionary).take(token.indices)
        l = l.filter(at.is_valid())
        at = pc.drop_null(at).to_numpy()
        group = np.zeros(len(l), np.int64)
        for k in keys:
            c = l.column(k).combine_chunks()
            c = (c.cast(c.type.value_type) if pa.types.is_dictionary(c.type) else c).dictionary_encode(null_encoding="encode")
            group = np.unique(group * len(c.dictionary) + c.indices.to_numpy(), return_inverse=True)[1]
        _, first, group = np.unique(group, return_index=True, return_inverse=True)
        row = code.indices.to_numpy()
        v = m.column("_vec").combine_chunks()
        v = v.flatten().to_numpy(zero_copy_only=False).reshape(len(m), -1)
        vec = np.zeros((len(code.dictionary), v.shape[1]))
        np.add.at(vec, row, v)  # a word with two vectors counts twice
        times, one = np.bincount(row, minlength=len(vec)), np.zeros(len(vec), int)
        one[row] = np.arange(len(row))
        number = l.column("m").to_numpy()
        w = weight(number.astype(np.float64), m.take(pa.array(one)).take(pa.array(at)))
        sums = np.stack([np.bincount(group, weights=w * vec[at, k], minlength=len(first)) for k in range(vec.shape[1])], axis=1)
        totals = [np.bincount(group, weights=x * times[at], minlength=len(first)) for x in (w, number)]
        keyed = [l.column(k).take(pa.array(first)) for k in keys]
        keyed = [c.cast(c.type.value_type) if pa.types.is_dictionary(c.type) else c for c in keyed]
        return pa.table([*keyed, pa.array(list(sums), pa.list_(pa.float64())), pa.array(totals[0]), pa.array(totals[1].astype(np.int64))],
                        names=[*keys, "vsum", "wsum", "n"])

    kinds = [to_arrow_type(terms.schema[k].dataType) for k in keys]

    def summed(l: pa.Table, m: pa.Table) -> pa.Table:
        if not len(l) or not len(m):
            return pa.table([pa.nulls(0, t) for t in [*kinds, pa.list_(pa.float64()), pa.float64(), pa.int64()]], names=[*keys, "vsum", "wsum", "n"])
        return run(l, m)
    rows = terms.select("_b", *keys, "token", "m").mapInArrow(_wrapped, "_b bigint, part binary")
    return rows.groupBy("_b").cogroup(need.groupBy("__b")).applyInArrow(lambda l, m: summed(l, m), schema)


def mean_doc_vectors(long: DataFrame, token_vecs: DataFrame, id_col: str = "doc_id",
                     keep: list[str] | None = None) -> DataFrame:
    """A8 + J2: plain mean of the token vectors of a document (repeats counted,
    tokens without a vector skipped).  Pre-aggregated to (doc, token, m)."""
    keep = keep or []
    if "m" not in long.columns:
        long = long.groupBy(*keep, id_col, "token").agg(F.count(F.lit(1)).alias("m"))
    sums = _sums_of_blocks(long, [*keep, id_col], token_vecs.select("token", F.col("vec").cast("array<double>").alias("vec")), lambda m, words: m)
    return sums.select(*keep, id_col, F.transform("vsum", lambda x: x / F.col("wsum")).alias("embedding"))


def weighted_doc_vectors(long: DataFrame, idf: DataFrame, token_vecs: DataFrame, a: float = 1e-3,
                         id_col: str = "doc_id") -> DataFrame:
    """A7 + J2 + J3: ``v = (1/n) * sum_i a / (a + cnt(t_i, d) * idf(t_i)) * vec(t_i)``.

    ``n`` is the number of token occurrences of the document that have a
    vector.  Occurrences of one token add the same term, so rows are
    pre-aggregated to ``(doc, token, m)`` and weighted by ``m * a/(a+m*idf)``.
    """
    m = long if "m" in long.columns else long.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("m"))
    words = idf.select("token", "idf").join(token_vecs.select("token", F.col("vec").cast("array<double>").alias("vec")), "token")

    def weight(m: np.ndarray, words: pa.Table) -> np.ndarray:
        return m * (a / (a + m * words.column("_idf").to_numpy()))
    sums = _sums_of_blocks(m.filter(F.col(id_col).isNotNull()), [id_col], words, weight)
    return sums.select(id_col, F.transform("vsum", lambda x: x / F.col("n")).alias("embedding"))


# ------------------------------------------------ centroid neighbourhoods ---

def representative_by_embedding(df: DataFrame, cluster_col: str, id_col: str, vec_col: str,
                                n: int = 3) -> DataFrame:
    """The ``n`` members nearest (cosine) to their cluster centroid.

    The centroid table has one row per cluster and is broadcast after a check of its number;
    beyond that a hot cluster is left to Spark's skew handling.
    """
    from sift.session import stored
    cents = stored(group_mean(df, [cluster_col], vec_col, "_centroid"))
    cents = F.broadcast(cents) if cents.count() <= MAX_BROADCAST_ROWS else cents
    d = df.join(cents, cluster_col).withColumn("dist", cosine_distance(vec_col, "_centroid"))
    d = d.withColumn("_d", F.round("dist", 9))
    return top_n_per_group(d.select(cluster_col, id_col, "dist", "_d"), [cluster_col],
                           [F.asc("_d"), F.asc(id_col)], n, salt_cols=[id_col]).drop("_d")


def _best(tokens: pa.Array, scores: np.ndarray, columns: pa.Array, col_name: str, n: int) -> pa.RecordBatch:
    """Of a block the ``n`` best tokens (highest score, ties by token) for each column."""
    names = np.array(tokens.to_pylist(), dtype=object)
    order = np.argsort(names, kind="stable")
    top = [order[np.argsort(-np.round(scores[order, c], 9), kind="stable")[:n]] for c in range(scores.shape[1])]
    at = np.concatenate(top) if top else np.zeros(0, np.int64)
    col = np.repeat(np.arange(len(top)), [len(t) for t in top])
    return pa.RecordBatch.from_arrays([columns.take(pa.array(col)), tokens.take(pa.array(at)), pa.array(scores[at, col])],
                                      names=[col_name, "token", "score"])


def nearest_token_per_centroid(token_vecs: DataFrame, centroids: DataFrame, cluster_col: str, dims: int) -> DataFrame:
    """J7 + M14: for each cluster centroid, the corpus token with the smallest cosine distance (ties by token).

    Blocks of tokens meet blocks of centroids in one matrix product each and hand on
    the best token per cluster.
    """
    from sift.operators.blocks import against, matrix, unit_rows
    kind = centroids.schema[cluster_col].dataType.simpleString()

    def run(l, m):
        return _best(l.field("token"), unit_rows(matrix(l, "vec")) @ unit_rows(matrix(m, "centroid")).T, m.field(cluster_col), cluster_col, 1)
    best = against(token_vecs.select("token", "vec"), "token", centroids.select(cluster_col, "centroid"), cluster_col, run,
                   f"{cluster_col} {kind}, token string, score double")
    best = best.withColumn("dist", F.lit(1.0) - F.col("score")).withColumn("_d", F.round("dist", 9))
    return top_n_per_group(best, [cluster_col], [F.asc("_d"), F.asc("token")], 1,
                           salt_cols=["token"]).drop("_d", "rank", "score")


def cosmul_titles(token_vecs: DataFrame, keywords: DataFrame, cluster_col: str, dims: int,
                  topn: int = 3, eps: float = 1e-6, negatives: bool = True) -> DataFrame:
    """M15 + J12 + A26: multiplicative-similarity titles.

    For cluster c with keyword set P (its keywords) and N (the distinct keywords
    of all other clusters; a word that c shares with another is in both):
    ``score(w) = prod_P (1+cos)/2 / (prod_N (1+cos)/2 + eps)``; without
    ``negatives`` the product over P alone.  All keyword words are excluded from the
    answers; top ``topn`` per cluster.  Products are sums of logs.  The product over N is that over all
    keywords without those that only c has, so a first pass sums over all keywords and a second one
    meets blocks of tokens with blocks of clusters; keywords of any number take the same way.
    """
    from sift.operators.blocks import against, matrix, unit_rows
    from sift.session import stored
    kw = keywords.select(cluster_col, "token").distinct().join(token_vecs.select("token", "vec"), "token")
    kw = stored(kw.withColumn("alone", F.lit(1)).join(
        kw.groupBy("token").agg(F.count(F.lit(1)).alias("owners")), "token").withColumn("alone", F.col("owners") == 1))
    kind = kw.schema[cluster_col].dataType.simpleString()
    candidates = token_vecs.select("token", "vec").join(keywords.select("token").distinct(), "token", "left_anti")

    def logs(u, vecs):
        return np.log(np.maximum((1.0 + u @ unit_rows(vecs).T) / 2.0, 1e-300))

    def total(l, m):
        return pa.RecordBatch.from_arrays([l.field("token"), pa.array(logs(unit_rows(matrix(l, "vec")), matrix(m, "vec")).sum(axis=1))],
                                          names=["token", "part"])
    if negatives:
        words = kw.select("token", "vec").dropDuplicates(["token"])
        sums = against(candidates, "token", words, "token", total, "token string, part double").groupBy("token").agg(F.sum("part").alias("whole"))
        candidates = stored(candidates.join(sums, "token"))
    else:
        candidates = candidates.withColumn("whole", F.lit(0.0))
    clusters = kw.groupBy(cluster_col).agg(F.collect_list(F.struct("vec", "alone")).alias("words"))

    def score(l, m):
        u, whole = unit_rows(matrix(l, "vec")), l.field("whole").to_numpy()
        scores = np.empty((len(l), len(m)))
        for c in range(len(m)):
            words = m.field("words")[c].values
            own = logs(u, matrix(words, "vec"))
            scores[:, c] = own.sum(axis=1)
            if negatives:
                only = own[:, words.field("alone").to_numpy(zero_copy_only=False)].sum(axis=1)
                scores[:, c] -= np.log(np.exp(whole - only) + eps)
        return _best(l.field("token"), scores, m.field(cluster_col), cluster_col, topn)
    best = against(candidates, "token", clusters, cluster_col, score, f"{cluster_col} {kind}, token string, score double", side_rows=64)
    best = best.withColumn("_s", F.round("score", 9))
    return top_n_per_group(best, [cluster_col], [F.desc("_s"), F.asc("token")], topn, salt_cols=["token"]).drop("_s")


def vocabulary_mean(token_vecs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Mean vector over the words of ``vocab`` that have a vector (one row)."""
    v = token_vecs.join(vocab.select("token").distinct(), "token", "left_semi")
    return v.agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("vec").cast("array<double>")))).alias("mean"),
                 F.count(F.lit(1)).alias("n_words"))


def sentence_vectors(long: DataFrame, word_list: DataFrame, token_vecs: DataFrame,
                     key_cols: list[str], min_tokens: int = 2) -> DataFrame:
    """J6 + A8 + F13: mean vector of the listed words of a sentence; sentences with
    fewer than ``min_tokens`` valid words get no vector and are dropped."""
    valid = long.join(word_list.select("token").distinct(), "token", "left_semi").join(token_vecs, "token")
    g = valid.groupBy(*key_cols).agg(
        F.count(F.lit(1)).alias("n_valid"),
        vector_to_array(Summarizer.mean(array_to_vector(F.col("vec").cast("array<double>")))).alias("embedding"))
    return g.filter(F.col("n_valid") >= min_tokens)


def train_word2vec(docs: DataFrame, tokens_col: str = "tokens", vector_size: int = 16, min_count: int = 5,
                   max_iter: int = 1, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """M1: token vectors learned on the corpus with Spark ML Word2Vec -> ``(token, vec)``.

    Words of fewer than ``min_count`` occurrences get no vector.  Spark keeps the
    vocabulary and its vectors on the driver (8 bytes x vocabulary x size, twice), so
    ``min_count`` bounds the job; ``partitions`` defaults to the session's parallelism."""
    from pyspark.ml.feature import Word2Vec
    w2v = Word2Vec(vectorSize=vector_size, minCount=min_count, maxIter=max_iter, seed=seed,
                   numPartitions=partitions or parallelism(docs.sparkSession), inputCol=tokens_col, outputCol="_w2v")
    model = w2v.fit(docs.select(tokens_col))
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vec"))


def batch_scorer(make_predict_fn, vector_size: int, batch_size: int = 256):
    """M2 + D3: Arrow-batched model scoring surface (``predict_batch_udf``).

    ``make_predict_fn()`` runs once per Python worker and returns a function
    from a NumPy batch of inputs to a ``(batch, vector_size)`` array.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType
    return predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)
