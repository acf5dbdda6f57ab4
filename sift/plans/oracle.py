"""DuckDB SQL that computes the same result as each registered Spark query.

Written independently of the Spark code, in DuckDB's dialect, over the
driver's pre-registered views.  Shared SQL fragments are built from the same
fixed word lists as the Spark side.
"""

from __future__ import annotations

from sift.functions import resources as R


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PUNCT = _q(R.PUNCTUATION)
STOP_LIST = "[" + ", ".join(_q(w) for w in R.STOP_WORDS) + "]"


def sql_keyword_tokens(col: str) -> str:
    toks = (f"list_filter(string_split_regex(lower(translate({col}, {PUNCT}, '')), '\\s+'), "
            f"lambda t: t <> '' AND NOT list_contains({STOP_LIST}, t))")
    return (f"list_filter(string_split(regexp_replace(array_to_string({toks}, ' '), '[^a-zA-Z]', ' ', 'g'), ' '), "
            f"lambda t: length(t) > 1)")


CLUSTER = "CAST(substr(source, 4) AS INTEGER)"

ORACLE: dict[str, str] = {}

ORACLE["topic_keywords_frequency"] = f"""
WITH d AS (SELECT doc_id, source, {sql_keyword_tokens('text')} AS tokens FROM documents),
t AS (SELECT source, unnest(tokens) AS token FROM d WHERE len(tokens) > 0),
c AS (SELECT source, token, count(*) AS cnt FROM t GROUP BY source, token),
r AS (SELECT source, token, row_number() OVER (PARTITION BY source ORDER BY cnt DESC, token) AS rk FROM c)
SELECT source, string_agg(token, ' ' ORDER BY rk) AS label FROM r WHERE rk <= 5 GROUP BY source
"""


def sql_map(mapping: dict) -> str:
    return "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in sorted(mapping.items())) + "}"


def sql_strip_html(col: str) -> str:
    s = col
    for pat in (r"(?s)<!--.*?-->", r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>",
                r"<[^>]*>", r"<[a-zA-Z/!][^>]*\z"):
        s = f"regexp_replace({s}, {_q(pat)}, ' ', 'g')"
    from html.entities import name2codepoint
    named = [(f"&{k};", chr(v)) for k, v in sorted(name2codepoint.items()) if k not in ("amp", "nbsp")]
    for ent, rep in [("&nbsp;", " "), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&#34;", '"'), *named, ("&amp;", "&")]:
        s = f"replace({s}, {_q(ent)}, {_q(rep)})"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def sql_tokenize(expr: str) -> str:
    return f"list_filter(string_split_regex(lower({expr}), '\\s+'), lambda t: t <> '')"


def sql_split_words(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '\\s+'), lambda t: t <> '')"


def sql_expand(toks: str, mapping: dict) -> str:
    return f"flatten(list_transform({toks}, lambda t: string_split(coalesce({sql_map(mapping)}[t], t), ' ')))"


def sql_resplit(toks: str, pat: str) -> str:
    return (f"list_filter(string_split(regexp_replace(array_to_string({toks}, ' '), {_q(pat)}, ' ', 'g'), ' '), "
            f"lambda t: t <> '')")


def sql_clean_tokens(col: str, stopwords: bool = True) -> str:
    t = sql_tokenize(sql_strip_html(col))
    t = sql_expand(t, R.CONTRACTIONS)
    t = sql_expand(t, R.ABBREVIATIONS)
    t = f"list_filter(list_transform({t}, lambda t: translate(t, {PUNCT}, '')), lambda t: t <> '')"
    if stopwords:
        t = f"list_filter({t}, lambda t: NOT list_contains({STOP_LIST}, t))"
    t = sql_resplit(t, "[^a-zA-Z0-9]")
    t = sql_resplit(t, "[^a-zA-Z]")
    return f"list_filter({t}, lambda t: length(t) >= 2)"


def sql_upper(x: str) -> str:
    return f"(upper({x}) = {x} AND lower({x}) <> {x})"


UPPER_RUN = _q(r"[a-z ]+[A-Z]{4,}")  # the original form; RE2 runs it in linear time
ACRONYM = _q(r"(^|[^A-Za-z0-9_])[A-Z]{2,3}([^A-Za-z0-9_]|$)")
PUNCT3 = _q(r"[^\w\s^(.)]{3,}")
PUNCT2 = _q(r"[^\w\s^(.)]{2,}")

ORACLE["clean_documents"] = f"""
WITH c AS (SELECT doc_id, {sql_clean_tokens('text')} AS tokens FROM documents)
SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, ' ') AS clean FROM c
"""

ORACLE["html_text"] = f"SELECT page_id, {sql_strip_html('html')} AS text FROM pages"

ORACLE["text_profile"] = f"""
WITH w AS (SELECT doc_id, text, {sql_split_words('text')} AS w FROM documents)
SELECT doc_id,
  CAST(len(string_split(text, ' ')) AS INTEGER) AS n_words,
  CAST(length(text) AS INTEGER) AS n_chars,
  CAST(len(list_filter(w, lambda t: list_contains({STOP_LIST}, t))) AS INTEGER) AS n_stop,
  CAST(len(list_filter(w, lambda t: t <> '' AND instr({PUNCT}, t) > 0)) AS INTEGER) AS n_punct,
  CAST(len(list_filter(w, lambda t: regexp_matches(t, '^[0-9]+$'))) AS INTEGER) AS n_numeric,
  CAST(len(list_filter(w, lambda t: {sql_upper('t')})) AS INTEGER) AS n_upper
FROM w
"""

ORACLE["caps_and_acronyms"] = f"""
WITH f AS (SELECT
  CAST({sql_upper('text')} AS INTEGER) AS all_upper,
  CAST(regexp_matches(text, {UPPER_RUN}) AS INTEGER) AS upper_run,
  CAST(regexp_matches(text, {ACRONYM}) AS INTEGER) AS acronym,
  CAST(regexp_matches(text, {PUNCT2}) AS INTEGER) AS punct2,
  CAST(regexp_matches(text, {PUNCT3}) AS INTEGER) AS punct3,
  CAST(regexp_matches(text, {PUNCT3}) AND NOT contains(text, '...') AS INTEGER) AS punct3_no_ellipsis
  FROM documents)
SELECT count(*) AS n_docs,
  CAST(sum(all_upper) AS BIGINT) AS n_all_upper, round(avg(all_upper), 6) AS share_all_upper,
  CAST(sum(upper_run) AS BIGINT) AS n_upper_run, round(avg(upper_run), 6) AS share_upper_run,
  CAST(sum(acronym) AS BIGINT) AS n_acronym, CAST(sum(punct2) AS BIGINT) AS n_punct2,
  CAST(sum(punct3) AS BIGINT) AS n_punct3, CAST(sum(punct3_no_ellipsis) AS BIGINT) AS n_punct3_no_ellipsis
FROM f
"""

ORACLE["symmetric_difference"] = f"""
SELECT doc_id, {sql_upper('text')} AS all_upper, regexp_matches(text, {UPPER_RUN}) AS upper_run
FROM documents WHERE {sql_upper('text')} <> regexp_matches(text, {UPPER_RUN})
"""

ORACLE["uppercase_tokens"] = f"""
WITH t AS (SELECT unnest({sql_split_words('text')}) AS token FROM documents)
SELECT token, count(*) AS cnt FROM t WHERE {sql_upper('token')}
GROUP BY token ORDER BY cnt DESC, token LIMIT 35
"""

_POS = "[" + ", ".join(_q(w) for w in R.CORPUS_POSITIVE_SEEDS) + "]"
_NEG = "[" + ", ".join(_q(w) for w in R.CORPUS_NEGATIVE_SEEDS) + "]"
ORACLE["seed_word_hits"] = f"""
WITH d AS (SELECT doc_id, source, lang, {sql_tokenize(f"translate(text, {PUNCT}, '')")} AS t FROM documents),
h AS (SELECT doc_id, source, lang,
  CAST(len(list_filter(t, lambda x: list_contains({_POS}, x))) AS INTEGER) AS pos_hits,
  CAST(len(list_filter(t, lambda x: list_contains({_NEG}, x))) AS INTEGER) AS neg_hits FROM d)
SELECT * FROM h WHERE pos_hits > 0 OR neg_hits > 0
"""


def sql_sentences(expr: str) -> str:
    marked = f"regexp_replace({expr}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: trim(x)), lambda x: x <> '')"


ORACLE["sentences"] = f"""
WITH s AS (SELECT doc_id, lang, {sql_sentences("replace(lower(text), '•', '')")} AS s FROM documents)
SELECT doc_id, lang, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sent_no, unnest(s) AS sentence FROM s
"""

ORACLE["conversation_sentences"] = f"""
WITH s AS (SELECT conv_id, turn, role, {sql_sentences('lower(text)')} AS s FROM conversations)
SELECT conv_id, turn, role, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sent_no, unnest(s) AS sentence FROM s
"""

ORACLE["ngrams"] = f"""
WITH d AS (SELECT {sql_keyword_tokens('text')} AS t FROM documents),
g AS (SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i+2], ' '))) AS ngram FROM d)
SELECT ngram, count(*) AS cnt FROM g GROUP BY ngram
"""

ORACLE["phrase_chunks"] = f"""
WITH w AS (SELECT doc_id, {sql_split_words(f"translate(text, {PUNCT}, '')")} AS w FROM documents),
l AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS token FROM w),
t AS (SELECT doc_id, pos, token, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS isl
      FROM l WHERE regexp_matches(token, '^[A-Z][a-z]+$'))
SELECT DISTINCT doc_id, string_agg(token, ' ' ORDER BY pos) AS phrase FROM t GROUP BY doc_id, isl
"""


_KW_DOCS = f"SELECT doc_id, CAST(substr(source, 4) AS INTEGER) AS cluster, {sql_keyword_tokens('text')} AS tokens FROM documents"
_KW_LONG = "SELECT cluster, doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos, len(tokens) AS n FROM d"

ORACLE["document_frequency_idf"] = f"""
WITH d AS ({_KW_DOCS}), l AS ({_KW_LONG}),
n AS (SELECT count(*) AS n FROM d WHERE len(tokens) > 0),
t AS (SELECT DISTINCT doc_id, token FROM l)
SELECT token, count(*) AS df, (SELECT n FROM n) AS n_docs, round(ln((SELECT n FROM n) / count(*)), 6) AS idf
FROM t GROUP BY token
"""

ORACLE["frequency_band_filter"] = f"""
WITH d AS ({_KW_DOCS}), l AS ({_KW_LONG}),
n AS (SELECT count(*) AS n FROM d WHERE len(tokens) > 0),
dft AS (SELECT token, count(DISTINCT doc_id) AS df FROM l GROUP BY token),
v AS (SELECT token FROM dft WHERE df >= 2 AND df <= floor(15 * (SELECT n FROM n) / 100)
      ORDER BY df DESC, token LIMIT 100000),
k AS (SELECT l.doc_id, count(v.token) AS n_kept,
             string_agg(CASE WHEN v.token IS NOT NULL THEN l.token END, ' ' ORDER BY l.pos) AS kept
      FROM l LEFT JOIN v ON l.token = v.token GROUP BY l.doc_id)
SELECT doc_id, CAST(n_kept AS INTEGER) AS n_kept, coalesce(kept, '') AS kept FROM k
"""

ORACLE["topic_keywords_tfidf"] = f"""
WITH d AS ({_KW_DOCS}), l AS ({_KW_LONG}),
nd AS (SELECT cluster, count(DISTINCT doc_id) AS n FROM l GROUP BY cluster),
tf AS (SELECT cluster, doc_id, token, count(*) AS tf FROM l WHERE length(token) >= 2 GROUP BY cluster, doc_id, token),
st AS (SELECT tf.cluster, token, count(*) AS df, sum(tf) AS total, any_value(nd.n) AS n
       FROM tf JOIN nd ON tf.cluster = nd.cluster GROUP BY tf.cluster, token),
fl AS (SELECT * FROM st WHERE df >= n * CAST(0.003 AS DOUBLE) AND df <= n * CAST(0.5 AS DOUBLE)),
vr AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY total DESC, token) AS rk FROM fl),
v AS (SELECT cluster, token, ln((n + 1) / (df + 1)) + 1 AS idf FROM vr WHERE rk <= 5000),
w AS (SELECT tf.cluster, tf.doc_id, tf.token, tf.tf * v.idf AS w FROM tf JOIN v ON tf.cluster = v.cluster AND tf.token = v.token),
nr AS (SELECT cluster, doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY cluster, doc_id),
s AS (SELECT w.cluster, w.token, arg_max(w.w / nr.norm, w.doc_id) AS score
      FROM w JOIN nr ON w.cluster = nr.cluster AND w.doc_id = nr.doc_id GROUP BY w.cluster, w.token),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, token) AS rank FROM s)
SELECT cluster, token, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
"""

ORACLE["topic_keywords_pooled"] = f"""
WITH d AS ({_KW_DOCS}), l AS ({_KW_LONG}),
nd AS (SELECT cluster, count(DISTINCT doc_id) AS n FROM l GROUP BY cluster),
tf AS (SELECT cluster, doc_id, token, count(*) AS tf FROM l WHERE length(token) >= 2 GROUP BY cluster, doc_id, token),
st AS (SELECT tf.cluster, token, count(*) AS df, sum(tf) AS total, any_value(nd.n) AS n
       FROM tf JOIN nd ON tf.cluster = nd.cluster GROUP BY tf.cluster, token),
fl AS (SELECT * FROM st WHERE df >= n * CAST(0.003 AS DOUBLE) AND df <= n * CAST(0.5 AS DOUBLE)),
v AS (SELECT cluster, token, ln((n + 1) / (df + 1)) + 1 AS idf FROM fl),
w AS (SELECT tf.cluster, tf.doc_id, tf.token, tf.tf * v.idf AS w FROM tf JOIN v ON tf.cluster = v.cluster AND tf.token = v.token),
nr AS (SELECT cluster, doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY cluster, doc_id),
p AS (SELECT w.cluster, w.token, max(w.w / nr.norm) AS hi, sum(w.w / nr.norm) AS total
      FROM w JOIN nr ON w.cluster = nr.cluster AND w.doc_id = nr.doc_id GROUP BY w.cluster, w.token),
s AS (SELECT 'max' AS pool, cluster, token, hi AS score FROM p UNION ALL SELECT 'sum', cluster, token, total FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY pool, cluster ORDER BY round(score, 9) DESC, token) AS rank FROM s)
SELECT pool, cluster, token, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
"""

ORACLE["corpus_tfidf"] = """
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents),
n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS n_rows FROM w GROUP BY token)
SELECT token, tf, n_rows, round(ln((SELECT n FROM n) / n_rows), 6) AS idf,
       round(tf * ln((SELECT n FROM n) / n_rows), 6) AS tfidf FROM s
"""

ORACLE["token_sequences"] = f"""
WITH d AS ({_KW_DOCS}), l AS ({_KW_LONG}),
c AS (SELECT token, count(*) AS cnt FROM l GROUP BY token),
v AS (SELECT token, row_number() OVER (ORDER BY cnt DESC, token) + 1 AS id FROM c),
ids AS (SELECT l.doc_id, l.pos, coalesce(v.id, 1) AS id FROM l LEFT JOIN v ON l.token = v.token AND v.id < 20000
        WHERE l.pos >= l.n - 30),
s AS (SELECT doc_id, list(id ORDER BY pos) AS seq FROM ids GROUP BY doc_id)
SELECT d.doc_id, array_to_string(list_concat(coalesce(s.seq, []),
       list_transform(range(30 - len(coalesce(s.seq, []))), lambda x: 0)), ' ') AS seq
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""

ORACLE["representative_statistical"] = f"""
WITH d AS ({_KW_DOCS}), l AS ({_KW_LONG}),
pd AS (SELECT cluster, doc_id, token, count(*) AS m FROM l GROUP BY cluster, doc_id, token),
c AS (SELECT cluster, token, sum(m) AS cnt FROM pd GROUP BY cluster, token),
mx AS (SELECT cluster, max(cnt) AS mx FROM c GROUP BY cluster),
rel AS (SELECT c.cluster, c.token, c.cnt / mx.mx AS rel FROM c JOIN mx ON c.cluster = mx.cluster),
w AS (SELECT pd.cluster, pd.doc_id, sum(pd.m * rel.rel) AS weight FROM pd JOIN rel
      ON pd.cluster = rel.cluster AND pd.token = rel.token GROUP BY pd.cluster, pd.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(weight, 9) DESC, doc_id) AS rank FROM w)
SELECT cluster, doc_id, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
"""


def sql_vec_string(expr_list: str) -> str:
    return f"array_to_string(list_transform({expr_list}, lambda x: printf('%.6f', round(x + 1e-10, 6) + 0.0)), ' ')"


_EMB_LONG = "SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings"

ORACLE["cluster_centroids"] = f"""
WITH e AS ({_EMB_LONG}), a AS (SELECT label, k, avg(x) AS m FROM e GROUP BY label, k)
SELECT label, string_agg(printf('%.6f', round(m + 1e-10, 6) + 0.0), ' ' ORDER BY k) AS centroid FROM a GROUP BY label
"""


def sql_cos_dist(a: str, b: str) -> str:
    return f"(1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


ORACLE["representative_embedding"] = f"""
WITH e AS ({_EMB_LONG}), a AS (SELECT label, k, avg(x) AS m FROM e GROUP BY label, k),
c AS (SELECT label, list(m ORDER BY k) AS cv FROM a GROUP BY label),
d AS (SELECT v.vec_id, v.label, {sql_cos_dist('CAST(v.embedding AS DOUBLE[])', 'c.cv')} AS dist
      FROM embeddings v JOIN c ON v.label = c.label),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(dist, 9), vec_id) AS rank FROM d)
SELECT label, vec_id, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
"""

ORACLE["minmax_scale"] = f"""
WITH e AS ({_EMB_LONG}), mm AS (SELECT k, min(x) AS lo, max(x) AS hi FROM e GROUP BY k)
SELECT vec_id, string_agg(printf('%.6f', round(CASE WHEN hi = lo THEN 0.0 ELSE (x - lo) / (hi - lo) END + 1e-10, 6) + 0.0), ' ' ORDER BY e.k) AS scaled
FROM e JOIN mm ON e.k = mm.k GROUP BY vec_id
"""

_TOY_VEC = ("list_transform(range(8), lambda k: ((ascii(substr(token, CAST((k % length(token)) + 1 AS INTEGER), 1)) * (k + 1)) % 31)"
            " / CAST(31.0 AS DOUBLE) - 0.5)")
_VEC_BASE = f"""d AS ({_KW_DOCS}), l AS ({_KW_LONG}),
tv AS (SELECT token, {_TOY_VEC} AS vec FROM (SELECT DISTINCT token FROM l)),
m AS (SELECT cluster, doc_id, token, count(*) AS m FROM l GROUP BY cluster, doc_id, token),
ev AS (SELECT m.cluster, m.doc_id, m.m, unnest(tv.vec) AS x, generate_subscripts(tv.vec, 1) AS k FROM m JOIN tv ON m.token = tv.token),
dvk AS (SELECT cluster, doc_id, k, sum(m * x) / sum(m) AS x FROM ev GROUP BY cluster, doc_id, k),
dv AS (SELECT cluster, doc_id, list(x ORDER BY k) AS v FROM dvk GROUP BY cluster, doc_id)"""

ORACLE["mean_document_vectors"] = f"""
WITH {_VEC_BASE}
SELECT doc_id, cluster, {sql_vec_string('v')} AS embedding FROM dv
"""

ORACLE["weighted_document_vectors"] = f"""
WITH d AS ({_KW_DOCS}), l AS ({_KW_LONG}),
n AS (SELECT count(*) AS n FROM d WHERE len(tokens) > 0),
idf AS (SELECT token, ln((SELECT n FROM n) / count(DISTINCT doc_id)) AS idf FROM l GROUP BY token),
tv AS (SELECT token, {_TOY_VEC} AS vec FROM (SELECT DISTINCT token FROM l)),
m AS (SELECT doc_id, token, count(*) AS m FROM l GROUP BY doc_id, token),
j AS (SELECT m.doc_id, m.m, m.m * (0.001 / (0.001 + m.m * idf.idf)) AS w, tv.vec
      FROM m JOIN idf ON m.token = idf.token JOIN tv ON m.token = tv.token),
e AS (SELECT doc_id, w, unnest(vec) AS x, generate_subscripts(vec, 1) AS k FROM j),
s AS (SELECT doc_id, k, sum(w * x) AS sx FROM e GROUP BY doc_id, k),
nn AS (SELECT doc_id, sum(m) AS n FROM j GROUP BY doc_id)
SELECT s.doc_id, string_agg(printf('%.6f', round(sx / n + 1e-10, 6) + 0.0), ' ' ORDER BY k) AS embedding
FROM s JOIN nn ON s.doc_id = nn.doc_id GROUP BY s.doc_id
"""

ORACLE["cluster_titles_projection"] = f"""
WITH {_VEC_BASE},
ck AS (SELECT cluster, k, avg(x) AS x FROM dvk GROUP BY cluster, k),
c AS (SELECT cluster, list(x ORDER BY k) AS cv FROM ck GROUP BY cluster),
dist AS (SELECT c.cluster, tv.token, {sql_cos_dist('tv.vec', 'c.cv')} AS dist FROM c, tv),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(dist, 9), token) AS rk FROM dist)
SELECT cluster, token AS title, round(dist, 6) AS dist FROM r WHERE rk = 1
"""

_KW_TOP5 = """kc AS (SELECT cluster, token, count(*) AS cnt FROM l GROUP BY cluster, token),
kr AS (SELECT cluster, token, row_number() OVER (PARTITION BY cluster ORDER BY cnt DESC, token) AS rk FROM kc),
kw AS (SELECT cluster, token, rk FROM kr WHERE rk <= 5)"""

_TITLE_SIMS = f"""d AS ({_KW_DOCS}), l AS ({_KW_LONG}),
tv AS (SELECT token, {_TOY_VEC} AS vec FROM (SELECT DISTINCT token FROM l)),
{_KW_TOP5},
cand AS (SELECT * FROM tv WHERE token NOT IN (SELECT token FROM kw)),
ls AS (SELECT cand.token, w.token AS word, ln((1 + (1 - {sql_cos_dist('cand.vec', 'w.vec')})) / 2) AS l
       FROM cand, (SELECT * FROM tv WHERE token IN (SELECT token FROM kw)) w),
pc AS (SELECT ls.token, kw.cluster, sum(l) AS pos FROM ls JOIN kw ON kw.token = ls.word GROUP BY ls.token, kw.cluster)"""

ORACLE["cluster_titles_multiplicative"] = f"""
WITH {_TITLE_SIMS},
neg AS (SELECT DISTINCT c.cluster, kw.token AS word FROM (SELECT DISTINCT cluster FROM kw) c JOIN kw ON kw.cluster <> c.cluster),
nc AS (SELECT ls.token, neg.cluster, sum(l) AS neg FROM ls JOIN neg ON neg.word = ls.word GROUP BY ls.token, neg.cluster),
sc AS (SELECT pc.cluster, pc.token, pos - ln(exp(neg) + 1e-6) AS score FROM pc JOIN nc ON pc.token = nc.token AND pc.cluster = nc.cluster),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, token) AS rank FROM sc)
SELECT cluster, token, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
"""

ORACLE["cluster_titles_positive"] = f"""
WITH {_TITLE_SIMS},
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(pos, 9) DESC, token) AS rank FROM pc)
SELECT cluster, token, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
"""

ORACLE["topic_summary"] = f"""
WITH {_VEC_BASE},
{_KW_TOP5},
kws AS (SELECT cluster, string_agg(token, ' ' ORDER BY rk) AS keywords FROM kw GROUP BY cluster),
ck AS (SELECT cluster, k, avg(x) AS x FROM dvk GROUP BY cluster, k),
c AS (SELECT cluster, list(x ORDER BY k) AS cv FROM ck GROUP BY cluster),
dd AS (SELECT dv.cluster, dv.doc_id, {sql_cos_dist('dv.v', 'c.cv')} AS dist FROM dv JOIN c ON dv.cluster = c.cluster),
rr AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(dist, 9), doc_id) AS rk FROM dd),
s AS (SELECT cluster, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY rk) AS sentence_ids FROM rr WHERE rk <= 3 GROUP BY cluster)
SELECT kws.cluster, kws.keywords, kws.keywords AS label, s.sentence_ids FROM kws LEFT JOIN s ON kws.cluster = s.cluster
"""


_PAIRS = """p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pr AS (SELECT a.vec_id AS q, b.vec_id AS s,
       sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist,
       a.v AS qv, b.v AS sv
       FROM p a JOIN p b ON a.vec_id <> b.vec_id)"""

ORACLE["knn_neighbors"] = f"""
WITH {_PAIRS},
r AS (SELECT q, s, dist, row_number() OVER (PARTITION BY q ORDER BY round(dist, 12), s) AS rank FROM pr)
SELECT q AS vec_id, s AS neighbor_id, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
"""

ORACLE["local_outlier_factor"] = f"""
WITH {_PAIRS},
r AS (SELECT q, s, dist, row_number() OVER (PARTITION BY q ORDER BY round(dist, 12), s) AS rk FROM pr),
nn AS (SELECT q, s, dist FROM r WHERE rk <= 20),
kd AS (SELECT q, max(dist) AS kdist FROM nn GROUP BY q),
lrd AS (SELECT nn.q, 1.0 / (sum(greatest(nn.dist, kd.kdist)) / 20 + 1e-10) AS lrd FROM nn JOIN kd ON nn.s = kd.q GROUP BY nn.q),
ml AS (SELECT nn.q, sum(l.lrd) / 20 AS mean_lrd FROM nn JOIN lrd l ON nn.s = l.q GROUP BY nn.q),
lof AS (SELECT ml.q, ml.mean_lrd / lrd.lrd AS lof FROM ml JOIN lrd ON ml.q = lrd.q),
cut AS (SELECT quantile_cont(-lof, 0.15) AS c FROM lof)
SELECT q AS vec_id, round(lof, 6) AS lof, (-lof >= (SELECT c FROM cut)) AS is_inlier FROM lof
"""

ORACLE["single_linkage"] = f"""
WITH RECURSIVE {_PAIRS},
e AS (SELECT q, s FROM pr WHERE 1 - list_dot_product(qv, sv) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(sv, sv))) < 0.62),
reach(id, lbl) AS (SELECT vec_id, vec_id FROM p UNION SELECT e.s, reach.lbl FROM reach JOIN e ON reach.id = e.q)
SELECT id AS vec_id, min(lbl) AS cluster FROM reach GROUP BY id
"""

ORACLE["density_clusters"] = f"""
WITH RECURSIVE {_PAIRS},
w AS (SELECT q, s FROM pr WHERE dist <= 1.12),
core AS (SELECT p.vec_id AS id FROM p LEFT JOIN (SELECT q, count(*) AS c FROM w GROUP BY q) x ON p.vec_id = x.q
         WHERE 1 + coalesce(x.c, 0) >= 2),
ce AS (SELECT w.q, w.s FROM w WHERE w.q IN (SELECT id FROM core) AND w.s IN (SELECT id FROM core)),
reach(id, lbl) AS (SELECT id, id FROM core UNION SELECT ce.s, reach.lbl FROM reach JOIN ce ON reach.id = ce.q),
comp AS (SELECT id, min(lbl) AS component FROM reach GROUP BY id),
sz AS (SELECT component, count(*) AS size FROM comp GROUP BY component),
good AS (SELECT comp.id, comp.component FROM comp JOIN sz ON comp.component = sz.component WHERE size >= 4)
SELECT p.vec_id, CAST(coalesce(good.component, -1) AS BIGINT) AS cluster FROM p LEFT JOIN good ON p.vec_id = good.id
"""

ORACLE["cosine_silhouette"] = """
WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pr AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj,
       1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS d
       FROM p a JOIN p b ON a.vec_id <> b.vec_id),
m AS (SELECT i, li, lj, avg(d) AS md FROM pr GROUP BY i, li, lj),
ab AS (SELECT i, max(CASE WHEN li = lj THEN md END) AS a, min(CASE WHEN li <> lj THEN md END) AS b FROM m GROUP BY i),
sz AS (SELECT label, count(*) AS n FROM p GROUP BY label),
s AS (SELECT ab.i, CASE WHEN sz.n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS s
      FROM ab JOIN p ON ab.i = p.vec_id JOIN sz ON p.label = sz.label)
SELECT round(avg(s), 6) AS silhouette FROM s
"""

ORACLE["cluster_sizes"] = """
WITH s AS (SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY label)
SELECT count(*) AS n_clusters, CAST(coalesce(sum(CASE WHEN cluster = -1 THEN size END), 0) AS BIGINT) AS n_outliers,
       CAST(sum(size) AS BIGINT) AS n_points, max(size) AS max_size, min(size) AS min_size, CAST(max(cluster) AS BIGINT) AS max_cluster
FROM s
"""


_RUNS = """runs AS (SELECT label AS grid_id, vec_id AS node, CASE WHEN label < 5 THEN 'kmeans' ELSE 'hdbscan' END AS mode,
        CASE WHEN CAST(embedding[1] AS DOUBLE) >= 0 THEN CAST(embedding[1] AS DOUBLE) END AS silhouette FROM embeddings)"""

ORACLE["best_config"] = f"""
WITH {_RUNS},
r AS (SELECT *, row_number() OVER (PARTITION BY mode, grid_id ORDER BY silhouette DESC, node) AS rk
      FROM runs WHERE silhouette IS NOT NULL)
SELECT mode, grid_id, node AS best_node, round(silhouette, 6) AS best_score FROM r WHERE rk = 1
"""

ORACLE["next_grid_id"] = f"""
WITH {_RUNS} SELECT CAST(coalesce(max(grid_id) + 1, 0) AS BIGINT) AS next_grid_id FROM runs
"""


_LEX = "(VALUES " + ", ".join(f"({_q(w)}, CAST({float(sc)!r} AS DOUBLE), {i})" for i, (w, sc) in enumerate(R.LEXICON + R.CORPUS_LEXICON)) + ") AS x(word, score, ord)"
_LEX_FEATS = f"""d AS (SELECT doc_id, {sql_clean_tokens('text', stopwords=False)} AS tokens FROM documents),
lex AS (SELECT word, arg_min(score, ord) AS score FROM {_LEX} GROUP BY word),
l AS (SELECT doc_id, unnest(tokens) AS word FROM d),
h AS (SELECT l.doc_id, sum(CASE WHEN score < 0 THEN score ELSE 0.0 END) AS neg_sum,
             sum(CASE WHEN score > 0 THEN score ELSE 0.0 END) AS pos_sum,
             count(CASE WHEN score < 0 THEN 1 END) AS n_neg, count(CASE WHEN score > 0 THEN 1 END) AS n_pos
      FROM l JOIN lex ON l.word = lex.word GROUP BY l.doc_id),
f AS (SELECT d.doc_id, coalesce(neg_sum, 0.0) AS neg_sum, coalesce(pos_sum, 0.0) AS pos_sum,
             CASE WHEN len(tokens) > 0 THEN coalesce(n_neg, 0) / len(tokens) ELSE 0.0 END AS neg_share,
             CASE WHEN len(tokens) > 0 THEN coalesce(n_pos, 0) / len(tokens) ELSE 0.0 END AS pos_share
      FROM d LEFT JOIN h ON d.doc_id = h.doc_id)"""

ORACLE["lexicon_features"] = f"""
WITH {_LEX_FEATS}
SELECT doc_id, round(neg_sum, 6) AS neg_sum, round(pos_sum, 6) AS pos_sum,
       round(neg_share, 6) AS neg_share, round(pos_share, 6) AS pos_share FROM f
"""

ORACLE["lexicon_sentiment"] = f"""
WITH {_LEX_FEATS}
SELECT doc_id, CAST(sign(pos_sum + neg_sum) AS INTEGER) AS sentiment FROM f
"""


_NW = _q(r"[^\p{L}\p{N}_-]")


def sql_clean_token(x: str) -> str:
    t = f"lower({x})"
    return (f"CASE WHEN length({t}) >= 2 THEN regexp_replace(substr({t}, 1, length({t}) - 2), {_NW}, '', 'g') || "
            f"CASE WHEN substr({t}, length({t}) - 1, 1) = '''' THEN '''' ELSE regexp_replace(substr({t}, length({t}) - 1, 1), {_NW}, '', 'g') END || "
            f"regexp_replace(substr({t}, length({t}), 1), {_NW}, '', 'g') ELSE regexp_replace({t}, {_NW}, '', 'g') END")


def _sql_positions(table: str, idc: str) -> str:
    return f"""(SELECT {idc} AS doc_id, pos, token, clean,
       CASE WHEN pos > 0 THEN c[pos] END AS prev, c[pos + 2] AS next FROM (
         SELECT {idc}, w, c, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS token, unnest(c) AS clean FROM (
           SELECT {idc}, string_split(text, ' ') AS w,
                  list_transform(string_split(text, ' '), lambda x: {sql_clean_token('x')}) AS c FROM {table})))"""


# DuckDB measures bytes: the corpus' accented letters become single unused ASCII signs first
_ACCENTED, _ONE_BYTE = "äöüßéèêëàâçñíóáúîïôûùœæ", "ABCDEFGHIJKLMNOPQRSTUVW"


def _lev(a: str, b: str) -> str:
    return f"levenshtein(translate({a}, '{_ACCENTED}', '{_ONE_BYTE}'), translate({b}, '{_ACCENTED}', '{_ONE_BYTE}'))"


_SPELL_BASE = f"""pos AS {_sql_positions('documents', 'doc_id')},
freq AS (SELECT clean, count(*) AS freq FROM pos WHERE clean <> '' GROUP BY clean),
dict AS (SELECT DISTINCT clean AS word FROM {_sql_positions('benchmark', 'item_id')} WHERE clean <> ''),
err AS (SELECT p.* FROM pos p LEFT JOIN freq f ON p.clean = f.clean
        WHERE p.pos > 0 AND NOT list_contains({STOP_LIST}, p.token) AND NOT list_contains({STOP_LIST}, p.clean)
          AND length(p.token) > 3 AND NOT regexp_matches(p.token, '^[A-Z]{{0,4}}\\W?s?\\z')
          AND regexp_matches(p.clean, '\\p{{L}}') AND f.freq <= 10
          AND p.clean NOT IN (SELECT word FROM dict)),
words AS (SELECT word FROM dict WHERE word IN (SELECT clean FROM freq WHERE freq > 10)),
cand AS (SELECT q.query, w.word, {_lev('q.query', 'w.word')} AS distance
         FROM (SELECT DISTINCT clean AS query FROM err) q, words w
         WHERE abs(length(q.query) - length(w.word)) <= 3 AND {_lev('q.query', 'w.word')} <= 3)"""

_SPELL_CHOICE = f"""bg AS (SELECT prev AS a, clean AS b, count(*) AS bc FROM pos WHERE prev IS NOT NULL AND prev <> '' AND clean <> '' GROUP BY prev, clean),
c AS (SELECT e.doc_id, e.pos, e.token, e.clean, cand.word, cand.distance,
             coalesce(b1.bc, 0) + coalesce(b2.bc, 0) AS context,
             CAST(substr(cand.word, 1, 1) = substr(e.clean, 1, 1) AS INTEGER) AS same_first, coalesce(f.freq, 0) AS wfreq
      FROM err e JOIN cand ON e.clean = cand.query
      LEFT JOIN bg b1 ON b1.a = e.prev AND b1.b = cand.word
      LEFT JOIN bg b2 ON b2.a = cand.word AND b2.b = e.next
      LEFT JOIN freq f ON f.clean = cand.word),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY same_first DESC, distance, context DESC, wfreq DESC, word) AS rk FROM c),
best AS (SELECT doc_id, pos, token, CASE WHEN {sql_upper('token')} THEN upper(word) ELSE word END AS correction,
                CAST(distance AS INTEGER) AS distance, context FROM r WHERE rk = 1)"""

ORACLE["spelling_errors"] = f"WITH {_SPELL_BASE} SELECT doc_id, CAST(pos AS INTEGER) AS pos, token, clean FROM err"

ORACLE["spelling_candidates"] = f"WITH {_SPELL_BASE} SELECT query, word, CAST(distance AS INTEGER) AS distance FROM cand"

ORACLE["spelling_corrections"] = f"""WITH {_SPELL_BASE}, {_SPELL_CHOICE}
SELECT doc_id, CAST(pos AS INTEGER) AS pos, token, correction, distance, context FROM best"""

ORACLE["spelling_report"] = f"""WITH {_SPELL_BASE}, {_SPELL_CHOICE},
o AS (SELECT p.doc_id, p.pos, p.token, coalesce(b.correction, p.token) AS out FROM pos p
      LEFT JOIN best b ON p.doc_id = b.doc_id AND p.pos = b.pos),
g AS (SELECT doc_id, string_agg(CASE WHEN token <> '' THEN token END, ' ' ORDER BY pos) AS original,
             string_agg(CASE WHEN out <> '' THEN out END, ' ' ORDER BY pos) AS corrected FROM o GROUP BY doc_id)
SELECT doc_id, original, corrected FROM g WHERE original <> corrected
"""


ORACLE["labelled_corpus"] = f"""
WITH j AS (SELECT d.doc_id, CAST(l.quality - l.toxic AS VARCHAR) AS label, d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id
           WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL),
t AS (SELECT doc_id, label, {sql_split_words(sql_strip_html('text'))} AS w FROM j),
e AS (SELECT doc_id, label, flatten(list_transform(w, lambda t: string_split(coalesce({sql_map(R.CONTRACTIONS)}[lower(t)], t), ' '))) AS w FROM t),
e2 AS (SELECT doc_id, label, flatten(list_transform(w, lambda t: string_split(coalesce({sql_map(R.ABBREVIATIONS)}[lower(t)], t), ' '))) AS w FROM e)
SELECT doc_id, label, array_to_string(list_filter(w, lambda t: length(t) >= 2), ' ') AS text FROM e2
"""

ORACLE["rows_per_question"] = "SELECT lang AS question, count(*) AS n_comments FROM documents GROUP BY lang"

ORACLE["first_comments"] = f"""
WITH d AS (SELECT doc_id, coalesce({CLUSTER}, -1) AS cluster FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY doc_id) AS rank FROM d WHERE cluster <> -1)
SELECT cluster, doc_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
"""


def sql_lemma(t: str) -> str:
    cases = []
    for suf, rep in R.PLURAL_RULES:
        cond = f"suffix({t}, {_q(suf)}) AND length({t}) > 3"
        if suf == "s":
            cond += " AND NOT (" + " OR ".join(f"suffix({t}, {_q(k)})" for k in R.PLURAL_KEEP) + ")"
        cases.append(f"WHEN {cond} THEN substr({t}, 1, length({t}) - {len(suf)}) || {_q(rep)}")
    return "CASE " + " ".join(cases) + f" ELSE {t} END"


ORACLE["lemmatized_tokens"] = f"""
WITH d AS ({_KW_DOCS}), l AS ({_KW_LONG})
SELECT doc_id, string_agg({sql_lemma('token')}, ' ' ORDER BY pos) AS lemmas FROM l GROUP BY doc_id
"""

ORACLE["noun_keywords"] = f"""
WITH d AS ({_KW_DOCS}),
s AS (SELECT DISTINCT cluster, doc_id, unnest(tokens) AS token FROM d),
c AS (SELECT cluster, token, count(*) AS df FROM s WHERE regexp_matches(token, '(tion|ment|ness|ity|ance|ence|ship|ism)$') GROUP BY cluster, token),
r AS (SELECT cluster, token, df * df AS pairs, row_number() OVER (PARTITION BY cluster ORDER BY df * df DESC, token) AS rank FROM c)
SELECT cluster, token, pairs, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
"""

ORACLE["keyword_pivot"] = f"""
WITH d AS (SELECT doc_id, lang AS question, {CLUSTER} AS cluster, {sql_keyword_tokens('text')} AS tokens FROM documents),
t AS (SELECT question, cluster, unnest(tokens) AS token FROM d),
c AS (SELECT question, cluster, token, count(*) AS cnt FROM t GROUP BY question, cluster, token),
r AS (SELECT *, row_number() OVER (PARTITION BY question, cluster ORDER BY cnt DESC, token) AS rk FROM c),
lab AS (SELECT question, cluster, string_agg(token, ' ' ORDER BY rk) AS label FROM r WHERE rk <= 3 GROUP BY question, cluster)
SELECT question, """ + ", ".join(f"max(CASE WHEN cluster = {c} THEN label END) AS \"{c}\"" for c in range(20)) + """ FROM lab GROUP BY question
"""


_WL = "wl AS (SELECT DISTINCT token FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS token FROM benchmark) WHERE token <> '')"

ORACLE["sentence_vectors"] = f"""
WITH s AS (SELECT doc_id, {sql_sentences("replace(lower(text), '•', '')")} AS s FROM documents),
ss AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS sent_no, unnest(s) AS sentence FROM s),
l AS (SELECT doc_id, sent_no, unnest(string_split_regex(sentence, '[^\\p{{L}}]+')) AS token FROM ss),
{_WL},
tv AS (SELECT token, {_TOY_VEC} AS vec FROM wl),
v AS (SELECT l.doc_id, l.sent_no, tv.vec FROM l JOIN tv ON l.token = tv.token),
e AS (SELECT doc_id, sent_no, unnest(vec) AS x, generate_subscripts(vec, 1) AS k FROM v),
m AS (SELECT doc_id, sent_no, k, avg(x) AS x, count(*) AS n FROM e GROUP BY doc_id, sent_no, k)
SELECT doc_id, CAST(sent_no AS INTEGER) AS sent_no, max(n) AS n_valid, string_agg(printf('%.6f', round(x + 1e-10, 6) + 0.0), ' ' ORDER BY k) AS embedding
FROM m GROUP BY doc_id, sent_no HAVING max(n) >= 2
"""

ORACLE["vocabulary_mean_vector"] = f"""
WITH d AS ({_KW_DOCS}), l AS ({_KW_LONG}), {_WL},
tv AS (SELECT token, {_TOY_VEC} AS vec FROM (SELECT DISTINCT token FROM l) WHERE token IN (SELECT token FROM wl)),
e AS (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS k FROM tv),
m AS (SELECT k, avg(x) AS x FROM e GROUP BY k)
SELECT (SELECT count(*) FROM tv) AS n_words, string_agg(printf('%.6f', round(x + 1e-10, 6) + 0.0), ' ' ORDER BY k) AS mean FROM m
"""

ORACLE["lof_per_question"] = f"""
WITH {_VEC_BASE},
p AS (SELECT dv.doc_id, doc.lang AS question, dv.v FROM dv JOIN documents doc ON dv.doc_id = doc.doc_id),
pr AS (SELECT a.question, a.doc_id AS q, b.doc_id AS s,
       sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist
       FROM p a JOIN p b ON a.question = b.question AND a.doc_id <> b.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(dist, 12), s) AS rk FROM pr),
nn AS (SELECT question, q, s, dist FROM r WHERE rk <= 20),
kd AS (SELECT q, max(dist) AS kdist FROM nn GROUP BY q),
lrd AS (SELECT nn.q, 1.0 / (sum(greatest(nn.dist, kd.kdist)) / 20 + 1e-10) AS lrd FROM nn JOIN kd ON nn.s = kd.q GROUP BY nn.q),
ml AS (SELECT nn.question, nn.q, sum(l.lrd) / 20 AS mean_lrd FROM nn JOIN lrd l ON nn.s = l.q GROUP BY nn.question, nn.q),
lof AS (SELECT ml.question, ml.q, ml.mean_lrd / lrd.lrd AS lof FROM ml JOIN lrd ON ml.q = lrd.q),
cut AS (SELECT question, quantile_cont(-lof, 0.15) AS c FROM lof GROUP BY question)
SELECT lof.question, q AS doc_id, round(lof, 6) AS lof, (-lof >= cut.c) AS is_inlier FROM lof JOIN cut ON lof.question = cut.question
"""


ORACLE["class_totals"] = """
SELECT CASE WHEN (((doc_id * 7919 + 42) % 1000003) // 97) % 10 < 1 THEN 'test' ELSE 'train' END AS split,
       quality - toxic AS sentiment, count(*) AS n_actual FROM labels GROUP BY ALL
"""

ORACLE["comments_per_group"] = """
SELECT source AS report_grouping, lang AS question, count(*) AS n_comments,
       CAST(sum(CASE WHEN length(text) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_filled, count(DISTINCT text) AS n_distinct
FROM documents GROUP BY source, lang
"""

ORACLE["cluster_members"] = """
WITH r AS (SELECT label, vec_id, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 100 AS INTEGER) AS chunk FROM embeddings)
SELECT label, chunk, count(*) AS n, string_agg(CAST(vec_id AS VARCHAR), ' ' ORDER BY vec_id) AS ids FROM r GROUP BY label, chunk
"""

ORACLE["silhouette_samples"] = """
WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pr AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj,
       list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
       FROM p a JOIN p b ON a.vec_id <> b.vec_id),
m AS (SELECT i, li, lj, avg(d) AS md FROM pr GROUP BY i, li, lj),
ab AS (SELECT i, li, max(CASE WHEN li = lj THEN md END) AS a, min(CASE WHEN li <> lj THEN md END) AS b FROM m GROUP BY i, li)
SELECT i AS vec_id, li AS label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM ab
"""

_TAGGED = f"""d AS ({_KW_DOCS}), l AS ({_KW_LONG}),
tg AS (SELECT doc_id, pos, token, CASE WHEN regexp_matches(token, '(tion|ment|ness|ity|ance|ence|ship|ism)$') THEN 'NOUN'
        WHEN suffix(token, 'ly') THEN 'ADV' WHEN suffix(token, 'ing') THEN 'VERB' ELSE 'X' END AS tag, {sql_lemma('token')} AS lemma FROM l)"""

ORACLE["normalised_by_tag"] = f"""
WITH {_TAGGED}
SELECT doc_id, string_agg(CASE WHEN tag = 'NOUN' THEN lemma ELSE token END, ' ' ORDER BY pos) AS tokens FROM tg WHERE tag <> 'ADV' GROUP BY doc_id
"""

ORACLE["annotation_lists"] = f"""
WITH {_TAGGED}
SELECT doc_id, string_agg(token || '/' || tag || '/' || lemma, ' ' ORDER BY pos) AS annotations FROM tg WHERE pos < 20 GROUP BY doc_id
"""

ORACLE["total_variance"] = f"""
WITH e AS ({_EMB_LONG}), v AS (SELECT k, var_samp(x) AS v FROM e GROUP BY k)
SELECT CAST(count(*) AS INTEGER) AS n_components, round(sum(v), 6) AS variance, CAST(1.0 AS DOUBLE) AS explained FROM v
"""

ORACLE["simple_corrections"] = f"""WITH {_SPELL_BASE},
keep AS (SELECT word FROM dict UNION SELECT clean FROM freq WHERE freq > 10),
s AS (SELECT doc_id, {sql_sentences('text')} AS s FROM documents),
ss AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS sent_no, unnest(s) AS sentence FROM s),
w0 AS (SELECT doc_id, sent_no, string_split(lower(sentence), ' ') AS w FROM ss),
w AS (SELECT doc_id, sent_no, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM w0),
q AS (SELECT DISTINCT word AS query FROM w WHERE word NOT IN (SELECT word FROM keep)),
c2 AS (SELECT q.query, words.word, {_lev('q.query', 'words.word')} AS distance FROM q, words
       WHERE abs(length(q.query) - length(words.word)) <= 2 AND {_lev('q.query', 'words.word')} <= 2),
rk AS (SELECT query, c2.word, row_number() OVER (PARTITION BY query ORDER BY distance, coalesce(freq, 0) DESC, c2.word) AS r
       FROM c2 LEFT JOIN freq ON freq.clean = c2.word)
SELECT w.doc_id, CAST(sent_no AS INTEGER) AS sent_no, string_agg(coalesce(rk.word, w.word), ' ' ORDER BY pos) AS corrected
FROM w LEFT JOIN rk ON rk.query = w.word AND rk.r = 1 GROUP BY w.doc_id, sent_no
"""
