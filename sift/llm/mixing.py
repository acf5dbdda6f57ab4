"""Mixing sources to target weights by soft domain membership.

A naive Bayes classifier over hashed words, trained on a bounded labelled table,
gives every document a posterior over the domains (from the mean word evidence,
counted as ``EVIDENCE`` words, so a long text is not certain by its length
alone).  Document rates 0 <= r <= max are then fitted by distributed least
squares: minimise sum_k (sum_d r_d n_d p_dk - T_k)^2 / W_k with n_d the tokens, p_d
the posterior, W_k the tokens at hand and T_k the target of domain k; of the rates
that do it, those nearest to 1 by sum_d n_d (r_d - 1)^2, which a weight ``NEAR`` adds.
They are r_d = clip(1 - sum_k m_k p_dk) for one multiplier a domain, which Newton
steps on the convex dual find in some thirty passes; a gradient on the rates themselves
needs thousands where a scarce domain has only a thousandth of some documents.
Documents of one posterior (rounded to ``DIGITS`` places) share a rate, so a pass
aggregates over distinct posteriors, and only sums by domain and by pair of domains
reach the driver.

Only DataFrame functions are used.  A document is drawn if a uniform number from
its id and text lies below its rate.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.llm.common import cut_lineage

BUCKETS = 1 << 14
EVIDENCE = 24.0
DIGITS = 3
MAX_LABELLED = 20_000
SMOOTH = 0.5
#: the totals are the least squares' within this share of what their domains hold: with the weight NEAR they lie
#: sqrt(NEAR) times the distance of the rates from 1 off, at most
EXACT = 1e-5
NEAR = EXACT ** 2
#: so many passes that do not get there are an error
ROUNDS = 500
BROADCAST_ROWS = 200_000

WORD_BREAK = r"[ \t\n\x0B\f\r]+"


def _words(text: Column) -> Column:
    """Words between ASCII white space, lower case; none for a null or empty text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def labelled_sample(labelled: DataFrame, domains: list[str], max_labelled: int = MAX_LABELLED) -> DataFrame:
    """At most ``max_labelled`` rows of ``labelled(doc_id, text, domain)`` of the named
    domains: the first by hash of the id.  Rows with a null id or domain are left out."""
    known = labelled.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    ids = (known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    return known.join(F.broadcast(ids), "doc_id", "left_semi")


def word_evidence(labelled: DataFrame, domains: list[str], max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, list[float]]:
    """``(bucket, e array<double>)`` log p(bucket | domain) for every bucket that occurs, and
    the log p of a bucket that does not, by domain."""
    sample = labelled_sample(labelled, domains, max_labelled)
    counts = cut_lineage(
        sample.select("domain", F.explode(_words(F.col("text"))).alias("w"))
        .groupBy(_bucket(F.col("w")).alias("bucket"))
        .agg(*[F.sum((F.col("domain") == d).cast("long")).alias(f"c{i}") for i, d in enumerate(domains)]))
    totals = counts.agg(*[F.sum(f"c{i}") for i in range(len(domains))]).first()
    totals = [float(t or 0) + SMOOTH * BUCKETS for t in totals]
    evidence = counts.select("bucket", F.array(*[
        F.log((F.col(f"c{i}") + SMOOTH) / totals[i]) for i in range(len(domains))]).alias("e"))
    return evidence, [math.log(SMOOTH / t) for t in totals]


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, text_hash, copies, n_tokens, p array<double>)``: one row per distinct
    (id, text), with its number of rows.  A text without words has equal posteriors."""
    evidence, unseen = word_evidence(labelled, domains, max_labelled)
    k = len(domains)
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), _words(F.col("text")).alias("words"))
    long = (rows.select("doc_id", "text_hash", F.size("words").cast("bigint").alias("n_tokens"),
                        F.posexplode_outer("words").alias("at", "w"))
            .withColumn("bucket", _bucket(F.col("w"))))
    e = F.coalesce("e", F.array(*[F.lit(u) for u in unseen]))
    scored = (long.join(F.broadcast(evidence), "bucket", "left")
              .groupBy("doc_id", "text_hash", "n_tokens")
              .agg(F.sum((F.col("at").isNull() | (F.col("at") == 0)).cast("long")).alias("copies"),
                   *[F.avg(F.when(F.col("at").isNotNull(), e[i])).alias(f"e{i}") for i in range(k)]))
    best = F.greatest(*[F.col(f"e{i}") for i in range(k)]) if k > 1 else F.col("e0")
    share = [F.coalesce(F.exp(EVIDENCE * (F.col(f"e{i}") - best)), F.lit(1.0)) for i in range(k)]
    whole = sum(share[1:], share[0])
    return scored.select("doc_id", "text_hash", "copies", "n_tokens",
                         F.array(*[F.round(s / whole, DIGITS) for s in share]).alias("p"))


def fit_rates(members: DataFrame, targets: dict[str, float], max_rate: float | None = 1.0,
              rounds: int = ROUNDS) -> tuple[DataFrame, dict]:
    """``members(copies, n_tokens, p)`` -> (``(p, rate)`` of every distinct posterior, the fit).

    ``targets``: share of the tokens by domain.  The total is the largest that no
    target exceeds what its domain holds (``max_rate`` times, if that is given), so
    the scarcest domain is taken whole.  A domain without tokens has no target.  The
    fit has what the domains hold, the targets and the expected totals that were reached.
    """
    domains = list(targets)
    k = len(domains)
    weight = F.col("copies") * F.col("n_tokens")
    profiles = cut_lineage(members.groupBy("p").agg(F.sum(weight.cast("double")).alias("w")))
    held = profiles.agg(*[F.sum(F.col("w") * F.col("p")[i]) for i in range(k)]).first()
    held = [float(x or 0) for x in held]
    want = [targets[d] if h > 0 else 0.0 for d, h in zip(domains, held)]
    if not sum(want) > 0:
        return profiles.select("p", F.lit(1.0).alias("rate")), {"held": held, "target": held, "expected": held, "rounds": 0}
    want = [x / sum(want) for x in want]
    budget = min(h / x for h, x in zip(held, want) if x > 0) * (max_rate or 1.0)
    target = [x * budget for x in want]
    target_, scale = np.array(target), np.array([h or 1.0 for h in held])
    multipliers, done = np.zeros(k), 0

    def look(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Totals, their change by the multipliers (negated) and the dual's sum over the posteriors, in one pass."""
        nonlocal done
        if done == rounds:
            raise RuntimeError(f"rates are not fitted after {rounds} passes")
        done += 1
        state = profiles.select("p", "w", *_rate(m, max_rate))
        free = F.col("rate") == F.col("ahead")
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = state.agg(
            *[F.sum(F.col("w") * F.col("rate") * F.col("p")[i]) for i in range(k)],
            *[F.sum(F.when(free, F.col("w") * F.col("p")[i] * F.col("p")[j])) for i, j in pairs],
            F.sum(F.col("w") * ((F.col("ahead") - 1.0) * F.col("rate") - (F.col("rate") - 1.0) ** 2 / 2))).first()
        change = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[k:-1]):
            change[i, j] = change[j, i] = x or 0.0
        return np.array([float(x) for x in row[:k]]), change, float(row[-1])

    # the weight falls in steps: each minimum starts the next one near its own
    for near in sorted({NEAR, *[10.0 ** -n for n in range(2, 10, 2)]}, reverse=True):
        totals, change, value = look(multipliers)
        value += near / 2 * scale @ multipliers ** 2 + target_ @ multipliers
        slope = near * scale * multipliers + target_ - totals
        while max(abs(slope) / scale) > EXACT / 10:
            unit = 1 / np.sqrt(scale)
            step = -unit * np.linalg.solve(near * np.eye(k) + change * np.outer(unit, unit), unit * slope)
            part = 1.0
            while True:
                at = multipliers + part * step
                totals, change, ahead = look(at)
                ahead += near / 2 * scale @ at ** 2 + target_ @ at
                rise = near * scale * at + target_ - totals
                # short of the minimum along the step, or far enough down
                if rise @ step <= 0 or ahead <= value + 1e-4 * part * (slope @ step):
                    break
                part /= 2
            multipliers, value, slope = at, ahead, rise
    rates = cut_lineage(profiles.select("p", *_rate(multipliers, max_rate)).select("p", "rate"))
    return rates, {"held": held, "target": target, "expected": [float(x) for x in totals], "rounds": done}


def _rate(multipliers, max_rate: float | None) -> list[Column]:
    """``ahead``: 1 less the posterior's multipliers; ``rate``: that within the bounds."""
    ahead = F.lit(1.0) - sum((F.col("p")[i] * float(m) for i, m in enumerate(multipliers)), F.lit(0.0))
    rate = F.greatest(F.lit(0.0), ahead)
    return [ahead.alias("ahead"), (rate if max_rate is None else F.least(F.lit(float(max_rate)), rate)).alias("rate")]


def _draw(seed: int) -> Column:
    """Uniform number in [0, 1) from id and text."""
    return F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], max_labelled: int = MAX_LABELLED,
        max_rate: float | None = 1.0, seed: int = 9) -> DataFrame:
    """``docs(doc_id, text)`` x ``labelled(doc_id, text, domain)`` ->
    ``(doc_id, text_hash, n_tokens, p_<domain>.., rate, kept)``, one row per row of ``docs``.

    ``kept``: drawn once at least (a rate above 1 stands for repeats).  A null or
    empty text has no tokens and equal posteriors; without any labelled row all
    posteriors are equal.  Repeated rows and rows with a null id keep their number;
    equal rows are drawn alike.  An empty table gives an empty table.  Only
    ``doc_id`` and ``text`` are read.
    """
    domains = list(targets)
    members = cut_lineage(posteriors(docs, labelled, domains, max_labelled))
    rates, _ = fit_rates(members, targets, max_rate)
    if rates.count() <= BROADCAST_ROWS:  # one row per distinct rounded posterior
        rates = F.broadcast(rates)
    return (members.join(rates, "p")
            .withColumn("_", F.explode(F.expr("array_repeat(0, cast(copies as int))")))
            .select("doc_id", "text_hash", "n_tokens",
                    *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate",
                    (_draw(seed) < F.col("rate")).alias("kept")))


def keep(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``mix`` draws."""
    drawn = (mix(docs, labelled, targets, **options).filter("kept")
             .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    # the hash is an expression of the condition: no column of ``docs`` is touched
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["_id"]) & (own == drawn["_hash"]), "left_semi")
