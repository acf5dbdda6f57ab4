"""Registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.llm import (
    kneser_ney, mixing, periodic, quality, rangecoder, ring, runindex, topk, trie_join, urlbloom, variants, warc, winnow,
)
from sift.llm.common import table

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: share of the tokens by domain; the domain of a labelled document is its language
MIX_TARGETS = {"en": 0.60, "de": 0.15, "fr": 0.15, "es": 0.10}


def domain_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled table of the mixing operator: the documents that ``labels`` covers, by language.

    The labelled ids are bounded before their texts are fetched.
    """
    ids = (table(spark, sf_dir, "labels").select("doc_id").filter("doc_id is not null").distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(mixing.MAX_LABELLED))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("domain"))
    return docs.join(F.broadcast(ids), "doc_id", "left_semi")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.report(winnow.contamination_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangecoder.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.near_duplicate_links(table(spark, sf_dir, "documents"))


def op5_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score(table(spark, sf_dir, "documents"), order=3)


def op7_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op8_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), domain_table(spark, sf_dir), MIX_TARGETS).drop("text_hash")


def op10_blocked_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlbloom.judge(table(spark, sf_dir, "pages"), rules)


def op11_maximal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(table(spark, sf_dir, "documents"))


def op12_index_first_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op13_trie_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_importance_resampling, op2_winnowing, op3_range_coder, op4_trie_join, op5_uniform_threshold, op6_kneser_ney,
                                  op7_bounded_ring, op8_run_length_index, op9_soft_mixing, op10_blocked_bloom, op11_maximal_pairs,
                                  op12_index_first_warc, op13_trie_frontier)}

LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32's byte table, by its rule; ``CRC32`` folds a list of bytes called ``bytes`` over it
CRC_TABLE = """t(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8)"""
CRC32 = ("xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)")

ORACLE = {
    "op2_winnowing": rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS w
       FROM b, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS t(i) WHERE len(words) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS w
       FROM (SELECT * FROM d, lens WHERE len(words) >= n), unnest(range(1, len(words) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, item_id, n, i FROM dw JOIN bw USING (n, w)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op4_trie_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + least(5, len(words)) - 1], ' ') AS w
      FROM d, unnest(range(1, len(words) - least(5, len(words)) + 2)) AS t(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
often AS (SELECT w, count(*) AS df FROM s GROUP BY w),
ranked AS (SELECT doc_id, w, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, w) AS r FROM s JOIN often USING (w) JOIN n USING (doc_id)),
rare AS (SELECT doc_id, w, n FROM ranked WHERE r <= n - CAST(ceil(0.75 * n) AS BIGINT) + 1),
may AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM rare x JOIN rare y USING (w)
        WHERE x.doc_id < y.doc_id AND 4 * least(x.n, y.n) >= 3 * greatest(x.n, y.n)),
common AS (SELECT a, b, na, nb, count(*) AS i FROM may JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.w = x.w GROUP BY a, b, na, nb),
e AS (SELECT a, b FROM common WHERE 100 * i >= 75 * (na + nb - i)),
e2 AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
reach(x, y) AS (SELECT x, x FROM e2 UNION SELECT reach.x, e2.y FROM reach JOIN e2 ON reach.y = e2.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x),
l AS (SELECT x AS doc_id, count(*) AS n_links FROM e2 GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)""",
    "op5_uniform_threshold": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op10_blocked_bloom": r"""
WITH p AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) u JOIN r
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (host, path)""",
    "op11_maximal_pairs": rf"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS raw,
             list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM documents),
h AS (SELECT doc_id, raw, len(raw) AS n, {CRC32} AS h FROM d, tab),
g AS (SELECT *, (h // 10) % greatest(n, 1) AS a, 3 + (h // 10) % 8 AS times FROM h),
p AS (SELECT *, 1 + (n - a) // times AS p FROM g),
w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
                CASE WHEN i < a THEN raw[i + 1] ELSE raw[a + (i - a) % p + 1] END) ELSE raw END AS words FROM p),
five AS (SELECT doc_id, n, i, array_to_string(words[i + 1:i + 5], ' ') AS s FROM w, unnest(range(0, n - 4)) AS u(i)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM five x JOIN five y ON x.doc_id = y.doc_id AND x.s = y.s AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isles AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length
          FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pairs) GROUP BY doc_id, q, isle),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM isles WHERE length >= 6 AND length >= 4 * q GROUP BY doc_id, start, length),
agg AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, i FROM runs, unnest(range(start + period, start + length)) AS u(i)),
kept AS (SELECT doc_id, string_agg(words[i + 1], ' ' ORDER BY i) AS s
         FROM (SELECT doc_id, words, i FROM w, unnest(range(0, n)) AS u(i)) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(agg.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM w LEFT JOIN agg USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_index_first_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS first, sha1(html) AS hex FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(hex, (i // 4) * 5 + 1, 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM r""",
    "op13_trie_frontier": rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, {LOWERED.replace('text', 'x')} AS w, count(*) AS m
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS x FROM documents) GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda x:
        CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
             ELSE [CAST(192 | (unicode(x) >> 6) AS BIGINT), CAST(128 | (unicode(x) & 63) AS BIGINT)] END)) AS bytes FROM r),
h AS (SELECT w, m, {CRC32} AS h FROM b, tab),
v AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM (SELECT m, CASE WHEN h % 31 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word FROM h)
      WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
cut AS (SELECT word, n, -1 AS i, word AS k FROM v UNION ALL
        SELECT word, n, i, left(word, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) FROM v, unnest(range(0, length(word))) AS u(i)),
near AS (SELECT DISTINCT x.word, x.n, y.word AS other, y.n AS other_n FROM cut x JOIN cut y ON x.k = y.k AND x.word <> y.word
         WHERE x.i = y.i OR x.i = -1 OR y.i = -1),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form,
             CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk(word, here, further) AS (SELECT word, word, form FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON walk.further = f.word)
SELECT f.word, form, here AS root, n, n_near, form_n FROM f JOIN walk ON walk.word = f.word AND walk.further IS NULL""",
}
