"""Jobs over the long token table ``(doc_id, pos, token)``.

The long table is the central relation: every vocabulary statistic is a
``groupBy`` on it (with map-side partial aggregation), every per-document
result is re-gathered by ``doc_id`` (a group bounded by one document), and
every per-cluster ranking goes through the salted two-phase top-n.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.functions.text import explode_nonempty
from sift.operators.topn import ordered_list, top_n_per_group


def token_table(df: DataFrame, tokens_col: str = "tokens", id_col: str = "doc_id",
                keep: list[str] | None = None) -> DataFrame:
    """Explode a token array into ``(keep..., id, pos, token)``; pos is 0-based."""
    keep = keep or []
    return explode_nonempty(df, [*keep, id_col], tokens_col, "token", "pos")


def regroup_tokens(long: DataFrame, id_col: str = "doc_id", out_col: str = "tokens",
                   keep: list[str] | None = None) -> DataFrame:
    """Inverse of :func:`token_table`: tokens back into an array in ``pos`` order.

    The group is one document, so its size is bounded by the document itself.
    """
    keep = keep or []
    return (long.groupBy(*keep, id_col)
                .agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("_l"))
                .select(*keep, id_col, F.transform("_l", lambda x: x["token"]).alias(out_col)))


def document_terms(long: DataFrame, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``(keep..., id, token, m)``: occurrences per document and token, written once (a compressed table).

    Every vocabulary statistic is an aggregate of this narrow table, so the texts are
    scanned and cleaned once per job."""
    from sift.session import stored
    return stored(long.groupBy(*(keep or []), id_col, "token").agg(F.count(F.lit(1)).alias("m")))


#: rows of a block of documents, as ``vectors`` sums them in one task
BLOCK_TERMS = 1_500_000


def _counted(keys: list[str], tokens_col: str):
    """Documents in batches -> ``(keys.., token, m, _b)``; about ``BLOCK_TERMS`` rows that follow each other share ``_b``."""
    def run(batches):
        from pyspark import TaskContext
        block, rows = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            tokens = batch.column(tokens_col)
            words = tokens.flatten().dictionary_encode()
            if not len(words):
                continue
            doc = np.repeat(np.arange(len(tokens)), pc.fill_null(tokens.value_lengths(), 0).to_numpy(zero_copy_only=False))
            of = len(words.dictionary)
            pair, m = np.unique(doc * of + words.indices.to_numpy(), return_counts=True)
            doc, word = pa.array(pair // of), pa.array(pair % of)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(doc) for k in keys], words.dictionary.take(word), pa.array(m.astype(np.int64)),
                                              pa.array(np.full(len(m), block))], names=[*keys, "token", "m", "_b"])
            rows += len(m)
            if rows >= BLOCK_TERMS:
                block, rows = block + 1, 0
    return run


def terms_of_documents(docs: DataFrame, tokens_col: str = "tokens", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """:func:`document_terms` of documents with token arrays, with the number ``_b`` of a block of documents: counted
    row by row, so only rows whose id comes again are shuffled."""
    from sift.session import bounded_batches, stored
    bounded_batches(docs.sparkSession)
    keys = [*(keep or []), id_col]
    schema = ", ".join([*(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys), "token string, m bigint, _b bigint"])
    again = stored(docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(F.col(id_col).alias("_id")))
    rows = docs.select(*keys, tokens_col)
    if again.isEmpty():
        return stored(rows.mapInArrow(_counted(keys, tokens_col), schema))
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    once = rows.join(again, same, "left_anti").mapInArrow(_counted(keys, tokens_col), schema)
    more = rows.join(again, same, "left_semi").mapInArrow(_counted(keys, tokens_col), schema).groupBy(*keys, "token").agg(F.sum("m").alias("m"))
    return stored(once.unionByName(more.withColumn("_b", -1 - F.pmod(F.xxhash64(id_col), F.lit(64)))))


def idf_from_terms(terms: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A2 from :func:`document_terms`: ``(token, df, n_docs, idf)``."""
    n = terms.select(id_col).distinct().count()
    return (terms.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("n_docs", F.lit(n).cast("long"))
            .withColumn("idf", F.log(F.col("n_docs") / F.col("df"))))


def token_counts(long: DataFrame, group_cols: list[str]) -> DataFrame:
    """A1: token frequency per group (partial aggregation before the shuffle); of a token
    table, or of :func:`document_terms`."""
    cnt = F.sum("m") if "m" in long.columns else F.count(F.lit(1))
    return long.groupBy(*group_cols, "token").agg(cnt.alias("cnt"))


def top_tokens(counts: DataFrame, group_cols: list[str], n: int = 5) -> DataFrame:
    """The ``n`` most frequent tokens per group; ties by token ascending."""
    return top_n_per_group(counts, group_cols, [F.desc("cnt"), F.asc("token")], n,
                           salt_cols=["token"])


def keyword_labels(long: DataFrame, group_cols: list[str], n: int = 5) -> DataFrame:
    """A1 -> W1 -> L2: one row per group with ``keywords`` (array) and ``label``."""
    top = top_tokens(token_counts(long, group_cols), group_cols, n)
    kw = ordered_list(top, group_cols, "rank", "token", "keywords")
    return kw.withColumn("label", F.array_join(F.slice("keywords", 1, 5), " "))


def document_frequency(long: DataFrame, id_col: str = "doc_id", group_cols: list[str] | None = None,
                       n_docs: DataFrame | int | None = None) -> DataFrame:
    """A2: document frequency and ``idf = ln(N / df)`` (no smoothing).

    ``N`` is the number of documents (per group when ``group_cols`` is set).
    The distinct ``(doc, token)`` step is itself an aggregation, so a hot
    token is combined map-side before it is shuffled.
    """
    group_cols = group_cols or []
    dft = (long.select(*group_cols, id_col, "token").distinct()
               .groupBy(*group_cols, "token").agg(F.count(F.lit(1)).alias("df")))
    if group_cols:
        totals = long.groupBy(*group_cols).agg(F.countDistinct(id_col).alias("n_docs"))
        dft = dft.join(totals, group_cols)
    else:
        if n_docs is None:
            n_docs = long.select(id_col).distinct().count()
        dft = dft.withColumn("n_docs", F.lit(int(n_docs)).cast("long"))
    return dft.withColumn("idf", F.log(F.col("n_docs") / F.col("df")))


def frequency_band(dft: DataFrame, no_below: int = 2, no_above_pct: int = 15,
                   keep_n: int | None = None) -> DataFrame:
    """A3: vocabulary with ``no_below <= df <= floor(no_above_pct% of N)``.

    With ``keep_n`` at most so many tokens stay (highest df first, then token) — a
    global top-n that Spark plans as a per-partition take-ordered with a bounded merge.
    """
    band = dft.filter((F.col("df") >= no_below) &
                      (F.col("df") <= F.floor(F.col("n_docs") * no_above_pct / 100)))
    if keep_n is not None:
        band = band.orderBy(F.desc("df"), F.asc("token")).limit(keep_n)
    return band.select("token", "df")


def _numbered(batches):
    """Documents with ``_b``: about ``BLOCK_TERMS`` tokens that follow each other share it."""
    from pyspark import TaskContext
    block, rows = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, block), pa.int64())], names=[*batch.schema.names, "_b"])
        rows += len(batch.column("tokens").flatten())
        if rows >= BLOCK_TERMS:
            block, rows = block + 1, 0


def _kept_of_block(l: pa.Table, m: pa.Table) -> pa.Table:
    """The tokens of a block's documents that are among its words ``m``, in their order."""
    from sift.operators.vectors import _unwrapped
    ids, out = [], []
    for part in _unwrapped(l.column("part"), False):
        words = part.column("tokens").combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        code = words.flatten().dictionary_encode()
        among = pc.is_in(code.dictionary, value_set=m.column("_token").combine_chunks()).to_numpy(zero_copy_only=False)
        keep = among[code.indices.to_numpy()] if len(code) else np.zeros(0, bool)
        ends = np.append(0, np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False)))
        kept = np.append(0, np.cumsum(keep))[ends]
        out.append(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.flatten().filter(pa.array(keep))))
        ids.append(part.column("doc_id"))
    ids = pa.chunked_array([c for x in ids for c in x.chunks], ids[0].type) if ids else None
    return pa.table([ids, pa.chunked_array(out)], names=["doc_id", "kept"])


def band_filtered(docs: DataFrame, no_below: int = 2, no_above_pct: int = 15) -> DataFrame:
    """A3: ``(doc_id, kept)`` of documents ``(doc_id, tokens)``: their tokens inside the frequency band, in order.

    A block of documents gets each of its words that are in the band once, and is shuffled as compressed batches; only the
    tokens of ids that come again are shuffled one by one (such an id has the tokens of all its rows)."""
    from sift.operators.vectors import _wrapped
    from sift.session import bounded_batches, stored
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.select("doc_id", "tokens").mapInArrow(_numbered, f"doc_id {kind}, tokens array<string>, _b bigint"))
    again = stored(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(F.col("doc_id").alias("_id")))
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    once, more = rows.join(again, same, "left_anti"), token_table(rows.join(again, same, "left_semi"))
    words = once.select("_b", F.explode(F.array_distinct("tokens")).alias("token"))
    df = (words.select("token").unionByName(more.select("doc_id", "token").distinct().select("token"))
          .groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("n_docs", F.lit(rows.count()).cast("long")))
    vocab = stored(frequency_band(df, no_below, no_above_pct))
    need = words.distinct().join(vocab.select("token"), "token", "left_semi").select(F.col("_b").alias("__b"), F.col("token").alias("_token"))
    packed = once.select("_b", "doc_id", "tokens").mapInArrow(_wrapped, "_b bigint, part binary")
    kept = packed.groupBy("_b").cogroup(need.groupBy("__b")).applyInArrow(lambda l, m: _kept_of_block(l, m), f"doc_id {kind}, kept array<string>")
    # a null id has no tokens of its own
    kept = kept.withColumn("kept", F.when(F.col("doc_id").isNotNull(), F.col("kept")).otherwise(F.array().cast("array<string>")))
    others = rows.select("doc_id").join(again, same, "left_semi").join(regroup_tokens(filter_tokens(more, vocab), "doc_id", "kept"), "doc_id", "left")
    return kept.unionByName(others.select("doc_id", F.coalesce("kept", F.array().cast("array<string>")).alias("kept")))


def filter_tokens(long: DataFrame, vocab: DataFrame) -> DataFrame:
    """Keep token rows whose token is in ``vocab`` (semi join on token)."""
    return long.join(vocab.select("token"), "token", "left_semi")


def tfidf_scores(long: DataFrame, cluster_col: str = "cluster", id_col: str = "doc_id",
                 min_df: float = 0.003, max_df: float = 0.5, max_features: int | None = None, pool: str = "last") -> DataFrame:
    """A4 + A5: per-cluster tf-idf keyword scores.

    Per cluster with ``n`` documents: keep tokens of length >= 2 with
    ``min_df*n <= df <= max_df*n``, with ``max_features`` keep so many tokens of the
    highest total count, ``idf = ln((1+n)/(1+df)) + 1``, L2-normalise each
    document's tf*idf vector, and score a term by ``pool``: its value in the ``last``
    document (highest ``doc_id``) that holds it, the ``max`` or the ``sum`` over the documents.
    ``long`` is a token table, or its :func:`document_terms`.
    """
    pooled = {"last": F.max_by("s", id_col), "max": F.max("s"), "sum": F.sum("s")}[pool]
    terms = long if "m" in long.columns else document_terms(long, id_col, [cluster_col])
    tf = terms.filter(F.length("token") >= 2).withColumnRenamed("m", "tf")
    ndocs = terms.groupBy(cluster_col).agg(F.countDistinct(id_col).alias("n"))
    stats = (tf.groupBy(cluster_col, "token")
               .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")))
    stats = stats.join(ndocs, cluster_col).filter(
        (F.col("df") >= F.col("n") * min_df) & (F.col("df") <= F.col("n") * max_df))
    vocab = stats if max_features is None else top_n_per_group(
        stats, [cluster_col], [F.desc("total"), F.asc("token")], max_features, salt_cols=["token"])
    vocab = vocab.withColumn("idf", F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1) \
                 .select(cluster_col, "token", "idf")
    w = tf.join(vocab, [cluster_col, "token"]).withColumn("w", F.col("tf") * F.col("idf"))
    norms = w.groupBy(cluster_col, id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scored = w.join(norms, [cluster_col, id_col]).withColumn("s", F.col("w") / F.col("norm"))
    return scored.groupBy(cluster_col, "token").agg(pooled.alias("score"))


def rank_keywords(scores: DataFrame, cluster_col: str = "cluster", n: int = 10) -> DataFrame:
    """L1: terms per cluster by score descending (ties by token); first ``n``."""
    r = scores.withColumn("_s", F.round("score", 9))
    return top_n_per_group(r, [cluster_col], [F.desc("_s"), F.asc("token")], n,
                           salt_cols=["token"]).drop("_s")


def corpus_tfidf(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                 n_rows: int | None = None) -> DataFrame:
    """Corpus term frequency on a single-space split, idf = ln(N / rows holding the term).

    This is the documented formula (row based); tf is the corpus count.
    """
    if n_rows is None:
        n_rows = docs.count()
    words = explode_nonempty(docs, [id_col], F.split(text_col, " ", -1), "token")
    per_row = words.groupBy("token", id_col).agg(F.count(F.lit(1)).alias("m"))
    stats = per_row.groupBy("token").agg(F.sum("m").alias("tf"), F.count(F.lit(1)).alias("n_rows"))
    return (stats.withColumn("idf", F.log(F.lit(float(n_rows)) / F.col("n_rows")))
                 .withColumn("tfidf", F.col("tf") * F.col("idf")))


def vocabulary_ids(long: DataFrame, num_words: int | None = None) -> DataFrame:
    """W6 + L10: ids by frequency (count desc, token asc); id 1 is out-of-vocabulary.

    Word of rank r gets id r + 1; with ``num_words`` only ids below it are kept, so
    the table then holds at most ``num_words - 2`` rows.  Without it the ranks come
    from a range partition by (count, token): a rank inside the partition after the
    words of the partitions before, so no task sorts the whole vocabulary.
    """
    from pyspark.sql import Window
    counts = long.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
    if num_words is not None:
        top = counts.orderBy(F.desc("cnt"), F.asc("token")).limit(max(num_words - 2, 0))
        return top.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("cnt"), F.asc("token"))) + 1).cast("int"))
    from sift.session import cut_lineage, parallelism
    parts = cut_lineage(counts.repartitionByRange(parallelism(long.sparkSession), F.desc("cnt"), F.asc("token"))
                        .withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(F.desc("cnt"), F.asc("token")))
    return (parts.withColumn("_r", inside).join(F.broadcast(before), "_p")
            .select("token", "cnt", (F.col("_b") + F.col("_r") + 1).cast("int").alias("id")))


def token_sequences(df: DataFrame, vocab: DataFrame, tokens_col: str = "tokens",
                    id_col: str = "doc_id", maxlen: int = 30) -> DataFrame:
    """Token ids, keep the last ``maxlen`` tokens, pad right with 0."""
    long = explode_nonempty(df.select(id_col, F.size(tokens_col).alias("_n"), F.col(tokens_col).alias("_t")),
                            [id_col, "_n"], "_t", "token", "pos") \
             .filter(F.col("pos") >= F.col("_n") - maxlen)
    ids = long.join(vocab.select("token", "id"), "token", "left") \
              .select(id_col, "pos", F.coalesce("id", F.lit(1)).alias("token"))
    seq = regroup_tokens(ids, id_col, "seq")
    seq = df.select(id_col).join(seq, id_col, "left") \
            .withColumn("seq", F.coalesce("seq", F.array().cast("array<int>")))
    return seq.withColumn("seq", F.concat("seq", F.array_repeat(F.lit(0), F.lit(maxlen) - F.size("seq"))))


def representative_statistical(long: DataFrame, cluster_col: str = "cluster", id_col: str = "doc_id",
                               n: int = 3) -> DataFrame:
    """W2 + W3: comments with the highest summed relative token frequency.

    weight(doc) = sum over its tokens (repeats counted) of
    ``cnt(cluster, token) / max cnt in the cluster``.  Token rows are
    pre-aggregated to ``(cluster, doc, token, m)`` before the join.
    """
    per_doc = document_terms(long, id_col, [cluster_col])
    counts = per_doc.groupBy(cluster_col, "token").agg(F.sum("m").alias("cnt"))
    mx = counts.groupBy(cluster_col).agg(F.max("cnt").alias("mx"))
    rel = counts.join(mx, cluster_col).select(cluster_col, "token", (F.col("cnt") / F.col("mx")).alias("rel"))
    weights = (per_doc.join(rel, [cluster_col, "token"])
                      .groupBy(cluster_col, id_col).agg(F.sum(F.col("m") * F.col("rel")).alias("weight")))
    weights = weights.withColumn("_w", F.round("weight", 9))
    return top_n_per_group(weights, [cluster_col], [F.desc("_w"), F.asc(id_col)], n,
                           salt_cols=[id_col]).drop("_w")


def lemma_table(vocab: DataFrame, lemma_expr) -> DataFrame:
    """T10 vocabulary job: distinct tokens -> ``(token, lemma)`` (rules or a user table)."""
    return vocab.select("token").distinct().withColumn("lemma", lemma_expr(F.col("token")))


def lemmatize_with_table(long: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Replace each token of the long table by its lemma (tokens without one stay)."""
    j = long.join(lemmas.select("token", "lemma"), "token", "left")
    return j.withColumn("token", F.coalesce("lemma", "token")).drop("lemma")


def expand_with_table(long: DataFrame, expansions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """T5/T6 for large dictionaries ``(key, expansion)``: join on the token, split the
    expansion into words and renumber positions (``pos * 1000 + word index`` keeps order)."""
    j = long.join(expansions.withColumnRenamed("key", "token"), "token", "left")
    words = F.split(F.coalesce("expansion", "token"), " ")
    e = j.select(id_col, "pos", F.posexplode(words).alias("_i", "_w"))
    return e.select(id_col, (F.col("pos") * 1000 + F.col("_i")).alias("pos"), F.col("_w").alias("token"))


def first_n_documents(df: DataFrame, n: int | None, id_col: str = "doc_id") -> DataFrame:
    """L3: exactly the first ``n`` documents by id (None keeps all)."""
    return df if n is None else df.orderBy(id_col).limit(n)


def shuffled(df: DataFrame, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """L4: a seeded, reproducible shuffle (order by a hash of id and seed)."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)))


def noun_keywords(docs: DataFrame, is_noun, cluster_col: str = "cluster", id_col: str = "doc_id",
                  tokens_col: str = "tokens", n: int = 10) -> DataFrame:
    """E6 + J10 + M17: per cluster the nouns shared by the most document pairs.

    The original counts, for every ordered pair of documents of a cluster
    (self pairs included), the nouns in both sets; a noun held by ``df``
    documents is counted ``df * df`` times.  So the score is ``df^2`` and no
    pair join is needed.  Top ``n`` by score, ties by token.
    """
    sets = explode_nonempty(docs, [cluster_col, id_col], F.array_distinct(tokens_col), "token") \
               .filter(is_noun(F.col("token")))
    dfc = sets.groupBy(cluster_col, "token").agg(F.count(F.lit(1)).alias("df"))
    dfc = dfc.withColumn("pairs", F.col("df") * F.col("df"))
    return top_n_per_group(dfc, [cluster_col], [F.desc("pairs"), F.asc("token")], n, salt_cols=["token"])


def normalise_by_tag(long: DataFrame, table: DataFrame, lemma_tags: list[str], drop_tags: list[str]) -> DataFrame:
    """Tokens whose tag is in ``lemma_tags`` become their lemma, those in ``drop_tags`` go.

    ``table(token, pos_tag, lemma)`` is a lexicon with one row per token; a token
    without a row stays as it is."""
    j = long.join(table.select("token", "pos_tag", "lemma"), "token", "left")
    kept = j.filter(F.col("pos_tag").isNull() | ~F.col("pos_tag").isin(drop_tags))
    token = F.when(F.col("pos_tag").isin(lemma_tags), F.coalesce("lemma", "token")).otherwise(F.col("token"))
    return kept.withColumn("token", token).drop("pos_tag", "lemma")


def annotations(long: DataFrame, table: DataFrame, limit: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """Per document the list of ``(token, pos_tag, lemma)`` in token order, the first ``limit`` of them.

    Positions past the limit leave before the join; a token without a row has null tag and lemma."""
    rows = long if limit is None else long.filter(F.col("pos") < limit)
    j = rows.join(table.select("token", "pos_tag", "lemma"), "token", "left")
    return (j.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "token", "pos_tag", "lemma"))).alias("_l"))
            .select(id_col, F.transform("_l", lambda x: F.struct(x["token"].alias("token"), x["pos_tag"].alias("pos_tag"),
                                                                 x["lemma"].alias("lemma"))).alias("annotations")))
