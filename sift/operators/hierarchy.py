"""Hierarchy of densities: condensed tree of a spanning tree, clusters of greatest stability.

Removing the edges of the spanning tree from the heaviest down splits it; a part of fewer than
``min_cluster_size`` points falls out of its cluster, a split into two or more larger parts ends the
cluster and begins new ones.  Edges of one weight go together.  The stability of a cluster is the sum over its
points of ``1/w`` at which they leave minus ``1/w`` at which the cluster began; a cluster is taken
if it is as stable as the best choice below it (the root is never taken).

The tree is condensed in pieces.  A piece of more than ``PIECE`` edges is cut at its median weight: the components
of the lighter edges become pieces of their own, and each is one node, with its number of points,
in the piece of the heavier edges.  Sizes are known before a piece is condensed, so all pieces are condensed side by
side, in tasks that stream over their edges by weight; a cluster that goes on in another piece is
found by following names.  A piece of equal weights is one event and is summed by groups.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.operators.graph import connected_components
from sift.operators.neighbors import dedupe_vectors
from sift.operators.spanning import spanning_tree
from sift.session import parallelism, stored

PIECE = 200_000
#: least weight: copies lie at distance 0
LEAST = 1e-10
ROWS = "kind string, name string, other string, size bigint, lam double"


def _pieces(nodes: DataFrame, edges: DataFrame, most: int):
    """``(nodes(node, piece, size, birth), edges(piece, a, b, w))`` of pieces that are small, or of one weight."""
    nodes, edges = nodes.withColumn("piece", F.lit("#")), edges.withColumn("piece", F.lit("#"))
    level = 0
    while True:
        stats = edges.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi"),
                                           F.percentile_approx("w", 0.5).alias("mid"))
        big = stored(stats.filter((F.col("n") > most) & (F.col("lo") < F.col("hi"))).select("piece", "mid", "hi"))
        if big.isEmpty():
            return nodes, edges
        level += 1
        marked = stored(edges.join(big, "piece", "left").withColumn(
            "light", F.when(F.col("mid") < F.col("hi"), F.col("w") <= F.col("mid")).otherwise(F.col("w") < F.col("hi"))))
        light = marked.filter("light").select("a", "b", "w")
        ends = light.select(F.col("a").alias("id")).union(light.select("b")).distinct()
        comp = connected_components(ends, light.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        comp = stored(comp.select(F.col("id").alias("node"), F.concat(F.lit(f"#{level}:"), "component").alias("sub")))
        inner = light.join(comp.withColumnRenamed("node", "a"), "a").select(F.col("sub").alias("piece"), "a", "b", "w")
        outer = marked.filter(~F.coalesce("light", F.lit(False))).select("piece", "a", "b", "w", F.col("mid").isNotNull().alias("cut"))
        for end in ("a", "b"):
            outer = (outer.join(comp.select(F.col("node").alias(end), F.col("sub").alias("_to")), end, "left")
                     .withColumn(end, F.when(F.col("cut"), F.coalesce("_to", end)).otherwise(F.col(end))).drop("_to"))
        edges = stored(inner.unionByName(outer.drop("cut")))
        moved = nodes.join(comp, "node", "left")
        whole = moved.filter("sub is not null").groupBy("sub").agg(F.first("piece").alias("piece"), F.sum("size").alias("size"))
        nodes = stored(moved.select("node", F.coalesce("sub", "piece").alias("piece"), "size", "birth").unionByName(
            whole.select(F.col("sub").alias("node"), "piece", "size", F.lit(None).cast("double").alias("birth"))))


def _lam(w: float) -> float:
    return 1.0 / max(w, LEAST)


class _Forest:
    """Parts of a piece while its edges come in by weight: size, open cluster, and the nodes of small parts."""

    def __init__(self, piece: str, least: int):
        self.piece, self.least, self.out = piece, least, []
        self.up, self.size, self.cluster, self.members = {}, {}, {}, {}
        self.born = 0

    def add(self, node: str, size: int, birth):
        if node in self.up:
            return
        self.up[node], self.size[node], self.cluster[node], self.members[node] = node, size, None, [node]
        if size >= self.least:
            if node.startswith("#"):  # its cluster is the one that its own piece ends with
                self.cluster[node] = node
            else:  # copies of one point
                self.cluster[node] = self.begin()
                self.event(self.cluster[node], size, birth)
                self.assign([node], self.cluster[node])
            self.members[node] = []

    def begin(self) -> str:
        self.born += 1
        return f"c{self.piece}/{self.born}"

    def event(self, cluster: str, size: int, w: float):
        self.out.append(("event", cluster, None, size, _lam(w)))

    def assign(self, nodes: list[str], target: str):
        self.out.extend(("assign", n, target, None, None) for n in nodes)

    def root(self, x: str) -> str:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def level(self, pairs: list[tuple[str, str]], w: float):
        """All edges of one weight at once."""
        groups: dict[str, set[str]] = {}
        before: dict[str, int] = {}  # what the parts had
        for a, b in pairs:
            a, b = self.root(a), self.root(b)
            if a == b:
                continue
            before.setdefault(a, self.size[a])
            before.setdefault(b, self.size[b])
            if self.size[a] < self.size[b]:
                a, b = b, a
            parts = groups.pop(a, {a})
            parts |= groups.pop(b, {b})
            groups[a] = parts
            self.up[b] = a
            self.size[a] += self.size[b]
        for top, parts in groups.items():
            self._merge(top, parts, w, before)

    def _merge(self, top: str, parts: set[str], w: float, before: dict[str, int]):
        large = [p for p in parts if self.cluster[p] is not None]
        small = [p for p in parts if self.cluster[p] is None]
        loose = [n for p in small for n in self.members.pop(p)]
        weight = sum(before[p] for p in small)
        total = self.size[top]
        self.members[top] = []
        if not large and total < self.least:
            self.members[top] = loose
            return
        if len(large) == 1:
            here = self.cluster[large[0]]
            if weight:
                self.event(here, weight, w)
        else:
            here = self.begin()
            self.event(here, total, w)
            for p in large:
                self.out.append(("split", self.cluster[p], here, None, _lam(w)))
        self.assign(loose, here)
        self.cluster[top] = here

    def close(self):
        tops = {self.root(n) for n in self.up}
        for top in tops:  # one: a piece is connected
            if self.cluster[top] is None:
                self.assign(self.members[top], self.piece)
            else:
                self.assign([self.piece], self.cluster[top])


def _condense(least: int):
    """Edges sorted by (piece, w) -> events, splits and assignments of names."""
    def batch_of(rows):
        kinds = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(kinds, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64()))],
                                          names=["kind", "name", "other", "size", "lam"])

    def run(batches):
        forest, pairs, w = None, [], None
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("piece", "w", "a", "b", "size_a", "size_b", "birth_a", "birth_b"))
            for piece, weight, a, b, na, nb, ba, bb in zip(*cols):
                if forest is None or piece != forest.piece or weight != w:
                    if pairs:
                        forest.level(pairs, w)
                        pairs = []
                    if forest is not None and piece != forest.piece:
                        forest.close()
                        yield batch_of(forest.out)
                        forest = None
                    w = weight
                if forest is None:
                    forest = _Forest(piece, least)
                forest.add(a, na, ba)
                forest.add(b, nb, bb)
                pairs.append((a, b))
            if forest is not None and len(forest.out) > 50_000:
                yield batch_of(forest.out)
                forest.out = []
        if forest is not None:
            forest.level(pairs, w)
            forest.close()
            yield batch_of(forest.out)
    return run


def _flat(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """What ``_condense`` gives, for pieces of one weight: one event each."""
    w = edges.groupBy("piece").agg(F.first("w").alias("w"))
    large = F.col("size") >= least
    own = F.when(F.col("node").startswith("#"), F.col("node")).otherwise(F.concat(F.lit("c"), "piece", F.lit("/"), "node"))
    rows = nodes.join(w, "piece").withColumn("own", F.when(large, own))
    sums = rows.groupBy("piece").agg(F.sum("size").alias("total"), F.sum(F.when(~large, F.col("size"))).alias("small"),
                                     F.count("own").alias("larges"), F.min("own").alias("only"), F.first("w").alias("w"))
    here = (F.when(F.col("larges") == 1, F.col("only")).when(F.col("total") >= least, F.concat(F.lit("c"), "piece", F.lit("/0")))
            .otherwise(F.col("piece")))
    sums = sums.withColumn("here", here)
    lam = 1.0 / F.greatest("w", F.lit(LEAST))
    none = F.lit(None)
    out = lambda df, kind, name, other, size, at: df.select(
        F.lit(kind).alias("kind"), name.alias("name"), other.cast("string").alias("other"), size.cast("bigint").alias("size"), at.cast("double").alias("lam"))
    both = rows.drop("w").join(sums, "piece")
    copies = rows.filter(large & ~F.col("node").startswith("#"))
    parts = [
        out(sums.filter("larges = 1 and small > 0"), "event", F.col("here"), none, F.col("small"), lam),
        out(sums.filter((F.col("larges") != 1) & (F.col("total") >= least)), "event", F.col("here"), none, F.col("total"), lam),
        out(both.filter("own is not null and larges > 1"), "split", F.col("own"), F.col("here"), none, lam),
        out(both.filter("own is null"), "assign", F.col("node"), F.col("here"), none, none),
        out(sums.filter((F.col("total") >= least)), "assign", F.col("piece"), F.col("here"), none, none),
        out(copies, "event", F.col("own"), none, F.col("size"), 1.0 / F.greatest("birth", F.lit(LEAST))),
        out(copies, "assign", F.col("node"), F.col("own"), none, none)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _resolved(names: DataFrame, column: str) -> DataFrame:
    """Rows of ``names(name, other)`` with ``other`` followed until it names a cluster: the chain halves each round."""
    while not names.filter(F.col(column).startswith("#")).isEmpty():
        step = names.select(F.col("name").alias(column), F.col(column).alias("_next"))
        ahead = names.join(step, column, "left").withColumn(column, F.coalesce("_next", column)).drop("_next")
        names = stored(ahead.select("name", column))
    return names


def condensed_tree(nodes: DataFrame, edges: DataFrame, min_cluster_size: int, most: int = PIECE):
    """``nodes(id, mult, core)``, spanning tree ``edges(a, b, w)`` ->
    ``(clusters(cluster, parent, size, stability), members(id, cluster))``.

    ``members`` has the cluster that a point falls out of; without any cluster of that size there are no rows.
    """
    least = int(min_cluster_size)
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    names = nodes.select(name("id").alias("node"), F.col("mult").alias("size"), F.col("core").alias("birth"))
    told = edges.select(name("a").alias("a"), name("b").alias("b"), "w")
    spark = nodes.sparkSession
    if (names.agg(F.sum("size")).first()[0] or 0) < least or told.isEmpty():
        # no cluster, or one point with its copies
        only = names.filter(F.col("size") >= least)
        root = F.concat(F.lit("c#/"), "node")
        density = F.col("size") / F.greatest("birth", F.lit(LEAST))
        return (only.select(root.alias("cluster"), F.lit(None).cast("string").alias("parent"), "size", density.alias("stability")),
                only.select(F.substring("node", 2, 1 << 30).alias("id"), root.alias("cluster")))
    piece_nodes, piece_edges = _pieces(names, told, most)
    sizes = piece_edges.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    flat = sizes.filter(F.col("n") > most).select("piece")
    rows = piece_edges.join(flat, "piece", "left_anti")
    for end in ("a", "b"):
        rows = rows.join(piece_nodes.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("birth").alias(f"birth_{end}")), end)
    # pieces are dealt whole; each is at most ``most`` edges
    rows = rows.repartition(parallelism(spark), "piece").sortWithinPartitions("piece", "w", "a", "b")
    found = rows.mapInArrow(_condense(least), ROWS)
    found = stored(found.unionByName(_flat(piece_nodes.join(flat, "piece", "left_semi"), piece_edges.join(flat, "piece", "left_semi"), least)))
    ends = _resolved(stored(found.filter("kind = 'assign'").select("name", "other")), "other")

    def real(df: DataFrame, column: str) -> DataFrame:
        to = ends.select(F.col("name").alias(column), F.col("other").alias("_real"))
        return df.join(to, column, "left").withColumn(column, F.coalesce("_real", column)).drop("_real")
    events = real(found.filter("kind = 'event'").select("name", "size", "lam"), "name")
    sums = events.groupBy("name").agg(F.sum("size").alias("size"), F.sum(F.col("size") * F.col("lam")).alias("left"))
    splits = real(real(found.filter("kind = 'split'").select("name", "other", "lam"), "name"), "other")
    clusters = sums.join(splits.select("name", F.col("other").alias("parent"), F.col("lam").alias("birth")), "name", "left")
    clusters = stored(clusters.select(F.col("name").alias("cluster"), "parent", "size",
                                           (F.col("left") - F.col("size") * F.coalesce("birth", F.lit(0.0))).alias("stability")))
    members = ends.filter(F.col("name").startswith("n")).select(F.substring("name", 2, 1 << 30).alias("id"), F.col("other").alias("cluster"))
    return clusters, members


def _chosen(table: pa.Table) -> pa.Table:
    """What ``stable_clusters`` gives, of a condensed tree that one task holds."""
    names, up, own = (table.column(c).to_pylist() for c in ("cluster", "parent", "stability"))
    parent, stability = dict(zip(names, up)), dict(zip(names, own))
    waiting, below, taken, order = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), {}, []
    for p in up:
        if p is not None:
            waiting[p] += 1
    ready = [c for c in names if not waiting[c]]
    while ready:
        c = ready.pop()
        order.append(c)
        p = parent[c]
        taken[c] = p is not None and stability[c] >= below[c]
        if p is not None:
            below[p] += max(stability[c], below[c])
            waiting[p] -= 1
            if not waiting[p]:
                ready.append(p)
    top: dict = {}
    for c in reversed(order):  # those above come first
        above = None if parent[c] is None else top[parent[c]]
        top[c] = above if above is not None else c if taken[c] else None
    return pa.table({"cluster": pa.array(order, pa.string()), "chosen": pa.array([top[c] for c in order], pa.string())})


def stable_clusters(clusters: DataFrame) -> DataFrame:
    """``(cluster, chosen)``: for every cluster the topmost taken one among itself and those above, or null.

    Clusters whose parts are all settled are settled in one round, so there are as many rounds as the
    condensed tree is high; then names are followed upwards, twice as far each round.  A tree of up to
    ``PIECE`` clusters is settled in one task.
    """
    if 0 < clusters.count() <= PIECE:
        whole = clusters.select("cluster", "parent", "stability").withColumn("_all", F.lit(0))
        return whole.groupBy("_all").applyInArrow(lambda t: _chosen(t), "cluster string, chosen string")
    open_ = stored(clusters.withColumn("below", F.lit(0.0)))
    settled = None
    while not open_.isEmpty():
        waiting = open_.filter("parent is not null").select(F.col("parent").alias("cluster")).distinct()
        now = open_.join(waiting, "cluster", "left_anti")
        now = now.select("cluster", "parent", (F.col("parent").isNotNull() & (F.col("stability") >= F.col("below"))).alias("taken"),
                         F.greatest("stability", "below").alias("best"))
        now = stored(now)
        settled = now if settled is None else stored(settled.unionByName(now))
        gain = now.groupBy(F.col("parent").alias("cluster")).agg(F.sum("best").alias("gain"))
        open_ = stored(open_.join(now.select("cluster"), "cluster", "left_anti").join(gain, "cluster", "left")
                            .withColumn("below", F.col("below") + F.coalesce("gain", F.lit(0.0))).drop("gain"))
    if settled is None:
        return clusters.select("cluster", F.col("cluster").alias("chosen"))
    way = settled.select("cluster", F.col("parent").alias("up"), F.when(F.col("taken"), F.col("cluster")).alias("chosen"))
    while not way.filter("up is not null").isEmpty():
        above = way.select(F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("chosen").alias("_chosen"))
        way = stored(way.join(above, "up", "left").select("cluster", F.col("_up").alias("up"), F.coalesce("_chosen", "chosen").alias("chosen")))
    return way.select("cluster", "chosen")


def density_hierarchy(points: DataFrame, id_col: str, vec_col: str, min_cluster_size: int = 100, min_samples: int | None = None,
                      alpha: float = 1.0, normalize: bool = False) -> DataFrame:
    """``(id, cluster)`` of every row with a vector, from the hierarchy of densities.

    ``min_samples`` is ``min_cluster_size`` unless given; ``alpha`` divides distances.  A cluster's label is its
    smallest id; points of no taken cluster are noise (-1).  Copies count as so many points at distance 0
    (their density is bounded by ``1 / LEAST``).  Rows with a null vector take no part; an empty table gives no rows.
    """
    reps, mapping = dedupe_vectors(points, id_col, vec_col, normalize)
    if reps.isEmpty():
        return mapping.select(F.col("orig_id").alias(id_col), F.lit(-1).cast("bigint").alias("cluster"))
    nodes, tree = spanning_tree(reps, min_samples or min_cluster_size, alpha)
    clusters, members = condensed_tree(nodes, tree, min_cluster_size)
    taken = members.join(stable_clusters(clusters), "cluster").filter("chosen is not null").select("id", "chosen")
    rows = stored(mapping.withColumn("_node", F.col("id").cast("string")).join(taken.withColumnRenamed("id", "_node"), "_node", "left"))
    label = rows.filter("chosen is not null").groupBy("chosen").agg(F.min("orig_id").alias("label"))
    return rows.join(label, "chosen", "left").select(F.col("orig_id").alias(id_col), F.coalesce("label", F.lit(-1)).cast("bigint").alias("cluster"))
