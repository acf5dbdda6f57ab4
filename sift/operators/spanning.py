"""Minimum spanning tree of mutual-reachability distances, as Boruvka rounds over grid blocks.

The weight of a pair is ``max(core(a), core(b), dist(a, b) / alpha)``; the core distance of a point
is the distance to its ``min_samples``-th nearest point, itself and its copies included.

A round finds the lightest edge that leaves every component.  Edges of the k-NN lists are known from
the start.  The lightest known edge of a component bounds the search: only points whose unseen
partners could be lighter ask the grid, with that bound as radius.  In the grid's cells a component
that fills half a block has blocks of its own, and two blocks of one component are never compared.
What a point has searched stays known: partners outside a component only get fewer.  Edges and
components are stored every round; the number of components halves at least.

In few dimensions there are no rounds: up to ``WHOLE`` points are one block, more are dealt to blocks of about ``linkage.TILE`` times
``SIDE`` by their first two coordinates.  An edge of the tree is one of the tree of any two blocks that hold its ends (Prim's
algorithm), so the trees of the pairs of blocks hold it; blocks farther apart than the heaviest edge on a way between them need not meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.operators import linkage
from sift.operators.graph import connected_components
from sift.operators.neighbors import BIG, BLOCK, SLACK, Grid, _distances, _matrix, _nearest
from sift.session import spread, stored

WHOLE, SIDE = 16_000, 2.5
#: as many edges of pairs of blocks are joined in one task
MOST = 8_000_000
#: a component with so many points in a cell has its own blocks
PURE = BLOCK // 2


def core_distances(grid: Grid, min_samples: int, k: int):
    """(``(id, core, low)``, k-NN edges ``(q, s, dist)``): no pair that is not listed is nearer than ``low``."""
    near = stored(_nearest(grid, F.least(F.lit(k), F.col("n") - 1).cast("int"), k).select("q", "s", "dist", "s_mult", "rank"))
    info = grid.points.select(F.col("id").alias("q"), "mult", "n", F.least(F.lit(min_samples), F.col("n_all")).alias("need"))
    listed = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("dist", "s_mult"))).alias("l"), F.max("dist").alias("far"))
    total = lambda i: F.aggregate(F.slice("l", 1, i), F.lit(0).cast("bigint"), lambda s, x: s + x["s_mult"])
    # of k + 1 rows at most: the first that makes the number of points
    enough = F.filter(F.sequence(F.lit(1), F.size("l")), lambda i: F.col("mult") + total(i) >= F.col("need"))
    core = F.when(F.col("mult") >= F.col("need"), 0.0).otherwise(F.get("l", F.get(enough, F.lit(0)) - 1)["dist"])
    points = info.join(listed, "q", "left").select(
        F.col("q").alias("id"), core.alias("core"),
        # a list of all other points leaves nothing unseen
        F.when(F.size("l") >= F.col("n") - 1, F.lit(BIG)).otherwise(F.coalesce("far", F.lit(0.0))).alias("low"))
    return points, near.select("q", "s", "dist")


def _packed(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Blocks of a cell, ``pure`` naming the component of a block that has only one."""
    crowd = rows.groupBy(*keys, "comp").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= PURE)
    marked = rows.join(crowd, [*keys, "comp"], "left").withColumn("pure", F.when(F.col("_n").isNotNull(), F.col("comp").cast("string")).otherwise(""))
    sizes = marked.groupBy(*keys, "pure").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_b"))
    salted = marked.join(sizes, [*keys, "pure"]).withColumn("_s", F.pmod(F.xxhash64("id"), F.col("_b")))
    return salted.groupBy(*keys, "pure", "_s").agg(F.collect_list(value).alias(name)).drop("_s")


def _weights(l: pa.Array, m: pa.Array, alpha: float) -> np.ndarray:
    """Weights of all pairs of two blocks, infinite inside a component."""
    w = _distances(_matrix(l, "v"), _matrix(m, "v")) / alpha
    w = np.maximum(w, np.maximum(l.field("core").to_numpy()[:, None], m.field("core").to_numpy()[None, :]))
    same = l.field("comp").to_numpy(zero_copy_only=False)[:, None] == m.field("comp").to_numpy(zero_copy_only=False)[None, :]
    return np.where(same, np.inf, w)


def _lightest(alpha: float):
    """Per row of the left block the lightest edge to another component, at most its bound ``u``."""
    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                l, m = batch.column("l")[n].values, batch.column("m")[n].values
                m = m.take(pa.array(np.argsort(m.field("id").to_numpy(zero_copy_only=False), kind="stable")))
                w, u = _weights(l, m, alpha), l.field("u").to_numpy()
                room = SLACK * np.maximum(1.0, np.minimum(u, 1e6))
                # the products are rough: pairs about as light as the lightest are measured by differences
                i, j = np.nonzero((w <= (w.min(axis=1) + room)[:, None]) & (w <= (u + room)[:, None]))
                if not len(i):
                    continue
                lv, mv = _matrix(l, "v"), _matrix(m, "v")
                exact = np.sqrt(((lv[i] - mv[j]) ** 2).sum(axis=1)) / alpha
                exact = np.maximum(exact, np.maximum(l.field("core").to_numpy()[i], m.field("core").to_numpy()[j]))
                order = np.lexsort((j, exact, i))
                first = order[np.append(True, i[order][1:] != i[order][:-1])]
                first = first[exact[first] <= u[i[first]]]
                yield pa.RecordBatch.from_arrays([l.field("id").take(pa.array(i[first])), m.field("id").take(pa.array(j[first])),
                                                  pa.array(exact[first])], names=["q", "s", "w"])
    return run


def _search(grid: Grid, points: DataFrame, asking: DataFrame, side: float, alpha: float) -> DataFrame:
    """``(q, s, w)``: the lightest edge, not above ``u``, from each row of ``asking(id, u)`` to another component."""
    here = Grid.__new__(Grid)
    here.points = points
    rows = points.join(asking, "id")
    asked = here.asked(F.col("u") * alpha + 1e-9, F.lit(side), rows)
    levels = [r[0] for r in asked.select("_level").distinct().collect()] or [0]
    keys = ["_g", "_level", "cx", "cy"]
    left = _packed(asked.select(*keys, "id", "v", "core", "comp", "u"), keys, F.struct("id", "v", "core", "comp", "u"), "l")
    right = _packed(here._members(F.lit(side), levels).select(*keys, "id", "v", "core", "comp"), keys, F.struct("id", "v", "core", "comp"), "m")
    left, right = left.withColumnRenamed("pure", "pl"), right.withColumnRenamed("pure", "pm")
    id_type = points.schema["id"].dataType.simpleString()
    met = left.join(right, keys).filter((F.col("pl") == "") | (F.col("pl") != F.col("pm"))).select("l", "m")
    found = spread(met).mapInArrow(_lightest(alpha), f"q {id_type}, s {id_type}, w double")
    best = found.groupBy("q").agg(F.min(F.struct("w", "s")).alias("b"))
    return best.select("q", F.col("b.s").alias("s"), F.col("b.w").alias("w"))


def _bounds(points: DataFrame, lacking: DataFrame, side: float, alpha: float) -> DataFrame:
    """Some edge ``(q, s, w)`` out of every component of ``lacking(comp)``: from cells that get wider until one has two components."""
    id_type = points.schema["id"].dataType.simpleString()
    found, level = None, 0
    while True:
        wide = side * 4.0 ** level
        rows = points.join(lacking.withColumn("u", F.lit(BIG)), "comp", "left").withColumn("u", F.coalesce("u", F.lit(-1.0)))
        rows = rows.withColumn("cx", F.floor((F.col("x") - F.col("x0")) / wide)).withColumn("cy", F.floor((F.col("y") - F.col("y0")) / wide))
        sizes = rows.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_b"))
        # another deal on every level
        rows = rows.join(sizes, ["cx", "cy"]).withColumn("_s", F.pmod(F.xxhash64("id", F.lit(level)), F.col("_b")))
        blocks = rows.groupBy("cx", "cy", "_s").agg(F.collect_list(F.struct("id", "v", "core", "comp", "u")).alias("l"))
        got = stored(spread(blocks.select("l", F.col("l").alias("m"))).mapInArrow(_lightest(alpha), f"q {id_type}, s {id_type}, w double"))
        found = got if found is None else found.unionByName(got)
        done = got.join(points.select(F.col("id").alias("q"), "comp"), "q").select("comp").distinct()
        lacking = stored(lacking.join(done, "comp", "left_anti"))
        if lacking.isEmpty():
            return found
        level += 1


def _prim(v: np.ndarray, core: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends and weights of the edges of a spanning tree of the points."""
    left = len(v) - 1
    cols, core, at = [np.ascontiguousarray(c) for c in v.T], core.copy(), np.arange(len(v))
    best, start = np.full(len(v), np.inf), np.zeros(len(v), int)
    a, b, w = np.zeros(max(left, 0), int), np.zeros(max(left, 0), int), np.zeros(max(left, 0))
    here = left  # the last point; those that are reached go to the end
    for n in range(left):
        m = left - n
        own, low = at[here], core[here]
        far = np.zeros(m)
        for c in cols:
            d = c[:m] - c[here]
            far += d * d
        far = np.maximum(np.maximum(np.sqrt(far) / alpha, core[:m]), low)
        nearer = far < best[:m]
        np.copyto(best[:m], far, where=nearer)
        start[:m][nearer] = own
        k = int(best[:m].argmin())
        a[n], b[n], w[n] = start[k], at[k], best[k]
        for x in (*cols, core, at, best, start):
            x[k], x[m - 1] = x[m - 1], x[k]
        here = m - 1
    return a, b, w


def _tree_of_blocks(alpha: float):
    """The spanning tree of the points of a group, as names and weights of its edges."""
    def run(table: pa.Table) -> pa.Table:
        names = table.column("id").combine_chunks()
        v = np.stack(table.column("v").to_numpy()).astype(np.float64)
        a, b, w = _prim(v, table.column("core").to_numpy().astype(np.float64), alpha)
        return pa.table([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(w), pa.repeat(table.column("pair")[0], len(a))], names=["a", "b", "w", "pair"])
    return run


def _lightest_forest(table: pa.Table) -> pa.Table:
    """Kruskal's choice of the edges."""
    table = table.combine_chunks()
    w = table.column("w").to_numpy()
    ends = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]).combine_chunks().dictionary_encode()
    code = ends.indices.to_numpy()
    a, b, order = code[:len(w)], code[len(w):], np.argsort(w, kind="stable")
    up, kept = list(range(len(ends.dictionary))), []
    for n, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[x] = y
            kept.append(n)
    return table.select(["a", "b", "w"]).take(pa.array(kept, pa.int64()))


def _block_tree(points: DataFrame, n: int, alpha: float) -> DataFrame | None:
    """Edges ``(a, b, w)`` of the spanning tree of ``points(id, v, core)`` of few dimensions, or nothing if too many blocks are near each other."""
    id_type = points.schema["id"].dataType.simpleString()
    schema = f"a {id_type}, b {id_type}, w double, pair int"
    rows = points.select("id", "v", "core")

    def trees(pairs: list[tuple[int, int]], first: int) -> DataFrame:
        table = points.sparkSession.createDataFrame([(t, first + i) for i, ij in enumerate(pairs) for t in ij], "_tile int, pair int")
        met = spread(dealt.join(F.broadcast(table), "_tile").select("id", "v", "core", "pair"), "pair")
        return stored(met.groupBy("pair").applyInArrow(lambda t: _tree_of_blocks(alpha)(t), schema))
    if n <= WHOLE:
        return stored(rows.withColumn("pair", F.lit(0)).groupBy("pair").applyInArrow(lambda t: _tree_of_blocks(alpha)(t), schema).drop("pair"))
    dealt = stored(linkage._tiled(rows, n, 0, SIDE).select("_tile", "id", "v", "core"))
    x, y = F.col("v")[0], F.coalesce(F.get("v", F.lit(1)), F.lit(0.0))
    boxes = np.array(sorted(tuple(r) for r in dealt.groupBy("_tile").agg(F.min(x), F.max(x), F.min(y), F.max(y)).collect()), float)  # a row a block
    apart = [np.maximum(0, np.maximum(lo[:, None] - hi[None], lo[None] - hi[:, None])) for lo, hi in ((boxes[:, 1], boxes[:, 2]), (boxes[:, 3], boxes[:, 4]))]
    gap, tiles, count = np.hypot(*apart) / alpha * (1 - 1e-9), boxes[:, 0].astype(int).tolist(), len(boxes)
    if count < 2:
        return None
    middles = np.stack([boxes[:, 1] + boxes[:, 2], boxes[:, 3] + boxes[:, 4]], axis=1) / 2
    i, j, _ = _prim(middles, np.zeros(count), 1.0)  # ways between all blocks
    ways = [tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())]
    edges = trees([(tiles[p], tiles[q]) for p, q in ways], 0)
    bound = np.full((count, count), np.inf)
    for r in edges.groupBy("pair").agg(F.max("w").alias("w")).collect():
        p, q = ways[r["pair"]]
        bound[p, q] = bound[q, p] = r["w"]
    for k in range(count):  # the heaviest edge on the best way
        bound = np.minimum(bound, np.maximum(bound[:, k, None], bound[None, k]))
    rest = [(p, q) for p in range(count) for q in range(p + 1, count) if gap[p, q] <= bound[p, q] and (p, q) not in set(ways)]
    if (len(rest) + len(ways)) * 2 * (n // count) > MOST:
        return None
    if rest:
        edges = edges.unionByName(trees([(tiles[p], tiles[q]) for p, q in rest], len(ways)))
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").distinct()
    return stored(edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(lambda t: _lightest_forest(t), f"a {id_type}, b {id_type}, w double"))


def spanning_tree(reps: DataFrame, min_samples: int, alpha: float = 1.0, lists: int = 8):
    """``reps(g, id, v, mult)`` (one group, no copies) -> (``(id, mult, core)``, edges ``(a, b, w)``)."""
    grid = Grid(reps)
    k = max(int(min_samples) - 1, lists)
    cores, near = core_distances(grid, int(min_samples), k)
    size, wide = grid.points.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if size and wide <= 4:
        nodes = stored(grid.points.join(cores, "id").select("id", "mult", "v", "core"))
        tree = _block_tree(nodes, size, alpha)
        if tree is not None:
            return nodes.select("id", "mult", "core"), tree
    points = stored(grid.points.join(cores, "id").withColumn("comp", F.col("id"))
                         .withColumn("low", F.greatest("core", F.col("low") / alpha)))
    core = points.select("id", "core")
    told = points.agg(F.min(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("span"), F.count(F.lit(1)).alias("n")).first()
    usual = points.filter(F.col("low") < BIG).agg(F.percentile_approx("low", 0.5).alias("m")).first()
    side = max(float((usual.m or 0.0) * alpha), float(told.span or 0.0) / 4096, 1e-9)

    def weighted(pairs: DataFrame) -> DataFrame:
        ends = pairs.join(core.select(F.col("id").alias("q"), F.col("core").alias("cq")), "q").join(core.select(F.col("id").alias("s"), F.col("core").alias("cs")), "s")
        return ends.select("q", "s", F.greatest(F.col("dist") / alpha, "cq", "cs").alias("w"))

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("s").alias("q"), F.col("q").alias("s"), "w"))

    known = stored(both(weighted(near)).distinct())
    tree = None
    while True:
        comp = points.select("id", "comp")
        if comp.select("comp").distinct().limit(2).count() < 2:
            break
        ends = lambda e: (e.join(comp.select(F.col("id").alias("q"), F.col("comp").alias("cq")), "q")
                          .join(comp.select(F.col("id").alias("s"), F.col("comp").alias("cs")), "s").filter("cq <> cs"))
        known = stored(ends(known).select("q", "s", "w"))
        lacking = stored(comp.select("comp").distinct().join(ends(known).select(F.col("cq").alias("comp")).distinct(), "comp", "left_anti"))
        if not lacking.isEmpty():
            known = stored(known.unionByName(both(_bounds(points, lacking, side, alpha))).distinct())
        bound = ends(known).groupBy(F.col("cq").alias("comp")).agg(F.min("w").alias("u"))
        asking = stored(points.join(bound, "comp").filter("low < u").select("id", "u"))
        if not asking.isEmpty():
            found = stored(_search(grid, points, asking, side, alpha))
            known = stored(known.unionByName(both(found)).distinct())
            # nothing outside is lighter than what was found, or than the bound
            seen = asking.join(found.select(F.col("q").alias("id"), "w"), "id", "left").select("id", F.coalesce("w", "u").alias("seen"))
            points = points.join(seen, "id", "left").withColumn("low", F.greatest("low", F.coalesce("seen", "low"))).drop("seen")
        a, b = F.least("q", "s"), F.greatest("q", "s")
        chosen = (ends(known).groupBy("cq").agg(F.min(F.struct("w", a.alias("a"), b.alias("b"))).alias("e"))
                  .select("e.a", "e.b", "e.w").distinct())
        chosen = stored(chosen)
        tree = chosen if tree is None else stored(tree.unionByName(chosen))
        met = ends(chosen.select(F.col("a").alias("q"), F.col("b").alias("s"), "w"))
        joined = connected_components(comp.select(F.col("comp").alias("id")).distinct(), met.select(F.col("cq").alias("src"), F.col("cs").alias("dst")))
        points = stored(points.join(joined.select(F.col("id").alias("comp"), "component"), "comp")
                             .withColumn("comp", F.col("component")).drop("component"))
    nodes = points.select("id", "mult", "core")
    if tree is None:
        tree = nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("core").alias("w")).filter("false")
    return nodes, tree
