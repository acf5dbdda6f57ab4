"""Quality classifier by importance resampling over hashed n-gram models.

A text is described by the set of its hashed n-grams: words (lower case), symbol
runs with the densities per word that they reach, and the densities that pairs
of equal words reach (other pairs of words only add noise at this table size:
97 % instead of 99 % of held-out good texts stayed).  Counted over documents, these give two
generative models over ``BUCKETS`` hash buckets: the target model from a bounded
sample of labelled good texts, the raw model from all texts.  The log importance
weight of a text is the sum over its n-grams of log(p_target / p_raw).  As the
raw texts hold the target's, a ratio above 1 tells which texts were labelled
rather than what they are: it counts as 1.  So does that of a bucket whose two
counts do not differ by ``z`` standard errors, or long texts would gather noise.

Texts are drawn without replacement in proportion to their weights by Gumbel
top-k: the k largest values of log weight + Gumbel noise stay, the noise being a
function of the document id.  k is the number of texts whose weight passes the
threshold that parts the labelled sample with the least error, so k follows the
corpus.  The k-th value is found by narrowing histograms, never by a global sort.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sift.llm.bytewords import LETTER_DIGIT, NOT_SPACE, U, chunks, mix, row_of, word_hashes
from sift.llm.common import cut_lineage, tidy

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
MAX_LABELLED = 200_000
PRIOR = 5.0
Z = 4.0
#: densities (per word, as powers of two) whose reaching is an n-gram of its own
LEVELS = (-99, -6, -3, -1)
#: log weight of a text without n-grams, below that of any other
NOTHING = -1e6
SYMBOL = NOT_SPACE & ~LETTER_DIGIT
SAME, STYLE = U(0x5A3E), U(0xC2B2AE3D27D4EB4F)


def _reached(keys: np.ndarray, rows: np.ndarray, count: np.ndarray, per: np.ndarray):
    """A (rows, keys) pair for every density level that the counts reach."""
    density = np.log2(count / np.maximum(per, 1))
    for level in LEVELS:
        at = density >= level
        yield rows[at], mix(keys[at] * STYLE + U(level + 128))


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text row, bucket) pairs of a chunk, by row."""
    h, _, _, first = word_hashes(buf, offs, LETTER_DIGIT)
    rows, per = row_of(first), np.diff(first)
    all_rows, all_keys = [rows], [h]
    same = (rows[1:] == rows[:-1]) & (h[1:] == h[:-1])
    repeats = np.bincount(rows[1:][same], minlength=len(per))
    at = np.flatnonzero(repeats)
    styles = [(np.full(len(at), SAME), at, repeats[at])]
    s, _, _, s_first = word_hashes(buf, offs, SYMBOL)
    s_rows = row_of(s_first)
    order = np.lexsort((s, s_rows))
    s, s_rows = s[order], s_rows[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (s_rows[1:] != s_rows[:-1])
    at = np.flatnonzero(new)
    styles.append((s[at], s_rows[at], np.diff(np.append(at, len(s)))))
    for keys, at_rows, count in styles:
        for r, k in _reached(keys, at_rows, count, per[at_rows]):
            all_rows.append(r)
            all_keys.append(k)
    keys = (np.concatenate(all_keys) >> U(64 - BUCKET_BITS)).astype(np.int64)
    both = np.unique((np.concatenate(all_rows).astype(np.int64) << BUCKET_BITS) | keys)
    return both >> BUCKET_BITS, both & (BUCKETS - 1)


def _count(batches):
    """Documents per bucket of a partition: all of them, and the target's."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    n_raw = n_target = 0
    for batch in batches:
        good = np.asarray(batch.column("is_target").fill_null(0).to_numpy(zero_copy_only=False)) == 1
        n_raw += len(good)
        n_target += int(good.sum())
        for i, _, buf, offs in chunks(batch.column("text")):
            rows, buckets = features(buf, offs)
            raw += np.bincount(buckets, minlength=BUCKETS)
            target += np.bincount(buckets[good[rows + i]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.append(at, -1)), pa.array(np.append(raw[at], n_raw)), pa.array(np.append(target[at], n_target))],
        names=["bucket", "raw", "target"])


def labelled_sample(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``labels(doc_id, quality, toxic)`` -> at most ``max_labelled`` rows ``(doc_id, is_target)``,
    the first by hash of the id.  A document of several rows is a target if all say so;
    rows with a null are left out."""
    per_doc = (labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id")
               .agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("is_target")))
    return per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def log_ratios(docs: DataFrame, sample: DataFrame, prior: float = PRIOR, z: float = Z) -> np.ndarray:
    """log(p_target / p_raw) of every bucket, 0 where it says nothing; the counts cover all rows of ``docs``."""
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left").select("text", "is_target")
    counts = cut_lineage(marked.mapInArrow(tidy(_count), "bucket bigint, raw bigint, target bigint")
                         .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    total = counts.filter("bucket = -1").first()
    ratio = np.zeros(BUCKETS, np.float32)
    if total is None or not total.target:
        return ratio
    n, n_t = float(total.raw), float(total.target)
    p = F.col("raw") / n
    told = (counts.filter("bucket >= 0").withColumn("p", p)
            .filter((F.col("p") * n_t - F.col("target")) >= z * F.sqrt(n_t * p * (1 - p) + 1e-12))
            .select("bucket", F.log((F.col("target") + prior * F.col("p")) / (n_t + prior) / F.col("p")).alias("ratio")))
    for r in told.collect():  # at most BUCKETS rows
        ratio[r.bucket] = min(r.ratio, 0.0)
    return ratio


def log_weight(ratios) -> Column:
    """Log importance weight of the column ``text``; ``ratios`` is a broadcast array."""
    @arrow_udf("double")
    def weigh(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text))
        for i, j, buf, offs in chunks(text):
            rows, buckets = features(buf, offs)
            out[i:j] = np.bincount(rows, weights=ratios.value[buckets], minlength=j - i)
            out[i:j][np.bincount(rows, minlength=j - i) == 0] = NOTHING
        return pa.array(out)
    return weigh(F.col("text"))


def gumbel(seed: int) -> Column:
    """Standard Gumbel noise from the document id."""
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 2048, most: int = 5000) -> float | None:
    """The k-th largest value of a column, exactly, by narrowing histograms."""
    if k <= 0:
        return None
    low, high = df.agg(F.min(column), F.max(column)).first()
    above, inside = 0, df
    while True:
        width = (high - low) / bins
        if not width > 0 or low + width == low:
            return high if width == 0 else low
        at = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width))
        found = sorted(inside.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"),
                                                         F.max(column).alias("high")).collect(), key=lambda r: -r.b)
        for r in found:
            if above + r.n >= k:
                break
            above += r.n
        inside = inside.filter(F.col(column).between(r.low, r.high))
        if r.n <= most:
            values = sorted((x[0] for x in inside.select(column).collect()), reverse=True)
            return values[k - above - 1]
        if (low, high) == (r.low, r.high):
            return low
        low, high = r.low, r.high


def least_error(values: np.ndarray, good: np.ndarray) -> float:
    """Threshold t of least error when values >= t are taken as good."""
    order = np.argsort(values, kind="stable")
    v, g = values[order], good[order]
    # taking v[i:]: errors are the good before i and the bad from i on
    errors = np.concatenate([[0], np.cumsum(g)]) + np.concatenate([[(~g).sum()], (~g).sum() - np.cumsum(~g)])
    allowed = np.append(True, np.append(v[1:] != v[:-1], True))
    i = int(np.argmin(np.where(allowed, errors, len(v) + 1)))
    if i == 0:
        return -np.inf
    if i == len(v):
        return np.inf
    return float((v[i - 1] + v[i]) / 2)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 17):
    """(scored rows ``(doc_id, log_weight, key)``, broadcast ratios, cutoff of the key).

    The least key that stays is the cutoff; None: nothing stays.
    """
    sample = cut_lineage(labelled_sample(labels, max_labelled))
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, sample))
    scored = cut_lineage(docs.select("doc_id", log_weight(ratios).alias("log_weight"))
                         .select("doc_id", "log_weight", (F.col("log_weight") + gumbel(seed)).alias("key")))
    judged = scored.join(F.broadcast(sample), "doc_id").select("log_weight", "is_target").toPandas()
    good = judged.is_target.to_numpy() == 1
    least = least_error(judged.log_weight.to_numpy(), good) if len(good) else -np.inf
    k = scored.filter(F.col("log_weight") >= F.lit(float(least))).count()
    cutoff = kth_largest(scored, "key", k)
    return scored, ratios, None if cutoff is None else max(cutoff, NOTHING / 2)


def resample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 17) -> DataFrame:
    """``docs(doc_id, text)`` x ``labels(doc_id, quality, toxic)`` ->
    ``(doc_id, log_weight, key, kept)``, one row per row of ``docs``.

    A null text, or one without n-grams, has the log weight ``NOTHING`` and goes.
    Every other text has 0 if no label names a target.  Rows with a null id share one noise value; rows
    with the same key stay or go together.  An empty table gives an empty table.
    Only ``doc_id`` and ``text`` are read.
    """
    scored, _, cutoff = fit(docs, labels, max_labelled, seed)
    kept = F.lit(False) if cutoff is None else F.col("key") >= F.lit(cutoff)
    return scored.withColumn("kept", kept)


def keep(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``resample`` keeps."""
    _, ratios, cutoff = fit(docs, labels, max_labelled, seed)
    if cutoff is None:
        return docs.limit(0)
    return docs.filter(log_weight(ratios) + gumbel(seed) >= F.lit(cutoff))
