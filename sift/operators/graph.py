"""Connected components as an iterative DataFrame job (large-star / small-star).

Every round links the larger neighbours of a vertex to the smallest vertex of
its neighbourhood (large-star), then the smaller ones (small-star), until each
component is a star around its smallest vertex.  The number of rounds grows with
the logarithm of the component size, not with its diameter; a long chain takes a
few.  There is no round limit: the loop ends when a round changes nothing.  Each
round's edges are checkpointed to the session's checkpoint directory (reliable,
so a lost executor repeats one round at most, and lineage stays short).

The last ``FINISH`` edges are joined in one task: a round costs some small jobs, whatever is left of the edges.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.session import cut_lineage, importable

FINISH = 200_000


def _joined(table: pa.Table) -> pa.Table:
    """``(u, v)``: every vertex of the edges and the smallest one of its component, unless that is itself."""
    up: dict = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x
    for u, v in zip(table.column("u").to_pylist(), table.column("v").to_pylist()):
        u, v = root(u), root(v)
        up[max(u, v)] = min(u, v)
    rows = [(x, y) for x in up if (y := root(x)) != x]
    return pa.table({c: pa.array([r[n] for r in rows], table.column(c).type) for n, c in enumerate(("u", "v"))})


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.filter(F.col("v") > F.col("u")).join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``vertices(id)``, ``edges(src, dst)`` (undirected) -> ``(id, component)``;
    component = smallest vertex id of the component.  Edges must join listed vertices."""
    e = edges.filter(F.col("src") != F.col("dst")).select(F.col("src").alias("u"), F.col("dst").alias("v"))
    e = cut_lineage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state(e)
    while before[0]:
        if before[0] <= FINISH:
            importable(e.sparkSession)
            kinds = ", ".join(f"{c} {e.schema[c].dataType.simpleString()}" for c in ("u", "v"))
            e = cut_lineage(e.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(lambda t: _joined(t.select(["u", "v"])), kinds))
            break
        e = cut_lineage(_small_star(_large_star(e)))
        now = state(e)
        if now == before:
            break
        before = now
    return (vertices.select("id").distinct().join(e.withColumnRenamed("u", "id"), "id", "left")
            .select("id", F.coalesce("v", "id").alias("component")))
