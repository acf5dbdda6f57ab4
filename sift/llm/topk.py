"""Exact top-k search by inner product with a three-phase uniform threshold.

A vector's components are dealt into ``lists`` parts; a score is the sum of its
parts' inner products, and each part is a score list of its own.

1. Every task gathers, per query and list, its rows with the ``k`` best partial
   scores; their whole scores are worked out, and the query's k-th best is a
   safe cutoff t: k rows reach it, so no row below t is among the k best.
2. The cutoffs are broadcast.  A row that reaches t has a part of at least
   t / lists, so every list gives up all entries of at least that much.
3. For those entries the remaining parts are added up exactly, and the k best
   rows that reach t are kept (ties to the smaller id).

Queries are taken in blocks of ``block`` (a bounded broadcast), each against
all rows; tasks hand on at most k rows a query each, and Spark merges them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sift.llm.common import cut_lineage

LISTS = 2
BLOCK = 1024
ROWS = 2048
FLOAT_EXACT = float(2**53)
NO_CUT = -(2**63)


def integer_vectors(df: DataFrame, scale: int = 1024) -> DataFrame:
    """``(vec_id, v array<bigint>)``: floor(scale * x); rows that take no part are left out.

    Left out: a null id, a null or empty vector, a null or non-finite component.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    fit = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (df.select("vec_id", x.alias("x"), F.coalesce(fit, F.lit(False)).alias("fit"))
            .filter("fit and vec_id is not null and size(x) > 0")
            .select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v")))


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products: through float64 while no sum can pass 2**53, else in int64."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < FLOAT_EXACT:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _by_length(ids, vecs):
    sizes = np.array([len(v) for v in vecs], np.int64)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), np.asarray(ids)[at], np.stack([vecs[i] for i in at]).astype(np.int64)


def _cuts(d: int, lists: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, d, min(lists, d) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _phase1(queries, lists: int, k: int) -> Callable:
    """Local score lists: the rows that lead one of a query's lists here, with whole scores."""
    def run(batches):
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for a in range(0, len(pdf), ROWS):
                for d, ids, v in _by_length(pdf.vec_id.to_numpy()[a: a + ROWS], pdf.v.to_numpy()[a: a + ROWS]):
                    if d not in queries.value:
                        continue
                    q_ids, q = queries.value[d]
                    parts = [_scores(q[:, s:e], v[:, s:e]) for s, e in _cuts(d, lists)]
                    total = sum(parts)
                    for i, qid in enumerate(q_ids.tolist()):
                        led = np.unique(np.concatenate([_best(ids, p[i], k + 1) for p in parts]))
                        led = led[ids[led] != qid]
                        got_ids, got = ids[led], total[i, led]
                        if qid in kept:
                            got_ids, got = np.concatenate([kept[qid][0], got_ids]), np.concatenate([kept[qid][1], got])
                        # a row may come once only for the cutoff; repeated rows are rows of their own
                        top = _best(got_ids, got, k)
                        kept[qid] = got_ids[top], got[top]
        for qid, (ids, got) in kept.items():
            yield pd.DataFrame({"query_id": qid, "vec_id": ids, "score": got})
    return run


def _phase23(queries, cutoffs, lists: int, k: int) -> Callable:
    """Entries of at least cutoff / lists in some list, resolved; those that reach the cutoff."""
    def run(batches):
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for a in range(0, len(pdf), ROWS):
                for d, ids, v in _by_length(pdf.vec_id.to_numpy()[a: a + ROWS], pdf.v.to_numpy()[a: a + ROWS]):
                    if d not in queries.value:
                        continue
                    q_ids, q = queries.value[d]
                    cut = np.array([cutoffs.value.get(x, NO_CUT) for x in q_ids.tolist()], np.int64)
                    ranges = _cuts(d, lists)
                    m = len(ranges)
                    parts = [_scores(q[:, s:e], v[:, s:e]) for s, e in ranges]
                    least = np.where(cut == NO_CUT, NO_CUT, -(-cut // m))
                    led = np.zeros(parts[0].shape, bool)
                    for p in parts:
                        led |= p >= least[:, None]
                    qi, vi = np.nonzero(led)
                    whole = sum(p[qi, vi] for p in parts)
                    keep = (whole >= cut[qi]) & (ids[vi] != q_ids[qi])
                    qi, vi, whole = qi[keep], vi[keep], whole[keep]
                    for i in np.unique(qi).tolist():
                        s, e = np.searchsorted(qi, [i, i + 1])
                        qid, got_ids, got = int(q_ids[i]), ids[vi[s:e]], whole[s:e]
                        if qid in kept:
                            got_ids, got = np.concatenate([kept[qid][0], got_ids]), np.concatenate([kept[qid][1], got])
                        top = _best(got_ids, got, k)
                        kept[qid] = got_ids[top], got[top]
        for qid, (ids, got) in kept.items():
            yield pd.DataFrame({"query_id": qid, "vec_id": ids, "score": got})
    return run


ENTRY = "query_id bigint, vec_id bigint, score bigint"


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, lists: int = LISTS, block: int = BLOCK) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``(query_id, rank, vec_id, score)``: each query's k
    best other rows by integer inner product, all of them if there are fewer.

    ``is_query`` picks the queries by ``vec_id``.  Equal scores go to the smaller
    id.  Vectors that are null or hold null or non-finite components take no
    part, nor do vectors of another length than the query's.  Of several query
    rows with one id the first in component order is the query; rows with the
    query's id are its own and no candidates, other repeated rows count each.
    Scores must lie within 64 bits.  An empty table gives an empty result.
    """
    if k < 1 or lists < 1 or block < 1:
        raise ValueError("k, lists and block must be positive")
    spark = vectors.sparkSession
    rows = cut_lineage(integer_vectors(vectors))
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    out = None
    pending: list = []

    def search(got):
        by_length = {}
        for d, q_ids, q in _by_length([r.vec_id for r in got], [np.array(r.v, np.int64) for r in got]):
            by_length[d] = q_ids, q
        queries = spark.sparkContext.broadcast(by_length)
        first = rows.mapInPandas(_phase1(queries, lists, k), ENTRY)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        cutoffs = {r.query_id: r.score for r in first.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k)
                   .select("query_id", "score").collect()}
        found = rows.mapInPandas(_phase23(queries, spark.sparkContext.broadcast(cutoffs), lists, k), ENTRY)
        return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))

    for row in asked.toLocalIterator():
        pending.append(row)
        if len(pending) == block:
            part, pending = search(pending), []
            out = part if out is None else out.unionByName(part)
    if pending or out is None:
        part = search(pending)
        out = part if out is None else out.unionByName(part)
    return out
