"""Agglomerative clustering (M5e): rounds of reciprocal nearest neighbours.

Ward, average and complete linkage are reducible: two clusters that are each other's nearest stay so
until they merge, so a round merges all such pairs at once and gives the merges of the sequential order.

* Ward (Euclidean) and average (cosine) need one row a cluster: size and mean vector.  The
  nearest cluster comes from the neighbour grid: the linkage distance to the nearest mean bounds it, that
  bound limits how far a better mean can lie, and a range join of that radius finds it.  Only clusters
  whose nearest one has merged look again.
* Complete linkage cut at a threshold keeps a cluster's outer members, its middle and how far a member lies from it.
  The distance of the middles is a lower bound of the distance of the farthest members, with both rooms added an upper
  one, so the range join of the middles hands on a few clusters, whose members are measured.  What has no partner within
  the threshold is done.

In the plane most merges are near: a round deals the clusters to tiles of about ``TILE`` of them, and a tile's task merges
what no cluster outside of it can be nearer to.  The last clusters (``NEAR_FINISH`` of means, ``FINISH`` of members) are merged in one
task.  With a threshold, what has no partner below it is done.  A cluster is named by its smallest member.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.operators.graph import connected_components
from sift.operators.neighbors import CHUNK, Grid, _nearest, dedupe_vectors
from sift.session import spread, stored

FINISH = 2000
NEAR_FINISH = 12_000  # means alone are held, no table of distances
TILE = 2000
CELLS = 1 << 21  # distances held at once


def _distance(method: str, squared: Column, n: str, m: str, a: str, b: str) -> Column:
    """Linkage distance from the squared distance of the means, the sizes and the squared lengths of the means."""
    if method == "ward":
        return F.sqrt(2.0 * F.col(n) * F.col(m) / (F.col(n) + F.col(m)) * squared)
    return F.greatest(F.lit(0.0), 1.0 - (F.col(a) + F.col(b) - squared) / 2)


def _radius(method: str) -> Column:
    """How far the mean of a cluster at linkage distance ``u`` or nearer can lie."""
    if method == "ward":  # the other cluster has a member at least
        return F.col("u") / F.sqrt(2.0 * F.col("n") / (F.col("n") + 1))
    return F.sqrt(F.greatest(F.lit(0.0), 2 * F.col("u") - (1 - F.col("sq"))))


def _bounds(method: str):
    """A lower and an upper bound of the linkage distance, for the blocks of ``Grid.pairs_within``."""
    def ward(d, room, a, n, b, m):
        factor = np.sqrt(2 * n * m / (n + m))
        return factor * (d - room), factor * (d + room)

    def average(d, room, a, n, b, m):
        h = 1 - (a * a + b * b - d * d) / 2
        return h - 1e-9, h + 1e-9
    return ward if method == "ward" else average


def _near_means(look: np.ndarray, x: np.ndarray, n: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, linkage distance) of the nearest other cluster of each row of ``look``; the first of equals."""
    near, h = np.zeros(len(look), int), np.full(len(look), np.inf)
    square = (x * x).sum(axis=1)
    rows = max(1, CELLS // len(x))
    for at in range(0, len(look), rows):
        own = look[at:at + rows]
        if method == "average":
            rough, room = (1 - x[own] @ x.T).clip(0), 1e-11
        else:
            if x.shape[1] <= 4:
                rough = np.zeros((len(own), len(x)))
                for c in x.T:
                    d = c[own, None] - c[None]
                    rough += d * d
            else:
                rough = (square[own, None] + square[None] - 2 * x[own] @ x.T).clip(0)
            rough *= 2 * n[own, None] * n[None] / (n[own, None] + n[None])
            # products are rough: those about as near as the nearest are measured by differences
            room = 1e-13 * (1 + float(square.max()) * (2 * float(n.max()) if x.shape[1] > 4 else 0))
        rough[np.arange(len(own)), own] = np.inf
        i, j = np.nonzero(rough <= rough.min(axis=1)[:, None] * (1 + 1e-9) + room)
        a, b = own[i], j
        if method == "average":
            exact = (1 - (x[a] * x[b]).sum(axis=1)).clip(0)
        else:
            exact = np.sqrt(2 * n[a] * n[b] / (n[a] + n[b]) * ((x[a] - x[b]) ** 2).sum(axis=1))
        order = np.lexsort((j, np.round(exact, 12), i))
        first = order[np.append(True, i[order][1:] != i[order][:-1])] if len(order) else order
        near[at + i[first]], h[at + i[first]] = j[first], exact[first]
    return near, h


def _edge(x: np.ndarray, tile: tuple | None) -> np.ndarray:
    """How far the points lie from the rim of a tile ``(x0, x1, y0, y1)``; outside of it below 0."""
    if tile is None:
        return np.full(len(x), np.inf)
    y = x[:, 1] if x.shape[1] > 1 else np.zeros(len(x))
    return np.minimum.reduce([x[:, 0] - tile[0], tile[1] - x[:, 0], y - tile[2], tile[3] - y])


def _outside(method: str, x: np.ndarray, n: np.ndarray, tile: tuple | None) -> np.ndarray:
    """A lower bound of the linkage distance to clusters whose mean lies outside of the tile."""
    edge = np.maximum(_edge(x, tile), 0.0)
    if method == "ward":  # the other cluster has a member at least
        return edge * np.sqrt(2 * n / (n + 1))
    return (edge * edge + 1 - (x * x).sum(axis=1)) / 2  # its mean is no longer than 1


def _mean_merges(ids: np.ndarray, n: np.ndarray, x: np.ndarray, method: str, tile: tuple | None = None, threshold: float | None = None):
    """Merges ``(a, b, height, size)`` of clusters in the order of their names, by rounds of reciprocal nearest ones that no cluster outside
    of the tile is nearer to, and the clusters ``(ids, n, x)`` that are left; with a threshold without those that have no partner below it."""
    out, most = [], np.inf if threshold is None else threshold
    near, h = np.full(len(ids), -1), np.full(len(ids), np.inf)
    while len(ids) > 1:
        look = np.flatnonzero(near < 0)
        near[look], h[look] = _near_means(look, x, n, method)
        outside = _outside(method, x, n, tile) * (1 - 1e-9) - 1e-12
        sure = np.ones(len(ids), bool) if tile is None else h < outside
        rows = np.arange(len(ids))
        a = np.flatnonzero((near[near] == rows) & (rows < near) & sure & sure[near] & (h < most))
        if not len(a):
            if tile is not None or h.min() >= most:
                break
            a = np.array([min(int(h.argmin()), int(near[h.argmin()]))])  # equals that are rounded otherwise: the least pair
            b = np.array([max(int(h.argmin()), int(near[h.argmin()]))])
        else:
            b = near[a]
        size = n[a] + n[b]
        out.append((ids[a], ids[b], h[a], size))
        x[a] = (n[a, None] * x[a] + n[b, None] * x[b]) / size[:, None]
        n[a] = size
        gone, moved = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        gone[b], moved[a], moved[b] = True, True, True
        near[moved | moved[near]] = -1
        # what has no partner below the threshold is no partner either
        kept = ~gone & ~((near >= 0) & (h >= most) & (outside >= most))
        place = np.cumsum(kept) - 1
        near = np.where((near >= 0) & kept[near], place[near], -1)[kept]
        ids, n, x, h = ids[kept], n[kept], x[kept], h[kept]
    if threshold is not None:
        done = (h >= most) & (_outside(method, x, n, tile) * (1 - 1e-9) - 1e-12 >= most)
        ids, n, x = ids[~done], n[~done], x[~done]
    merges = [np.concatenate(c) for c in zip(*out)] if out else [ids[:0], ids[:0], np.zeros(0), np.zeros(0)]
    return merges, (ids, n, x)


def _ordered(table: pa.Table) -> tuple[pa.Table, tuple | None]:
    """A tile's clusters in the order of their names, and its rim if it has one."""
    table = table.combine_chunks()
    rim = tuple(table.column(c)[0].as_py() for c in ("t0", "t1", "t2", "t3"))
    return table.take(pc.sort_indices(table.column("id"))).combine_chunks(), None if rim[0] is None else rim


def _mean_rounds(method: str, threshold: float | None):
    """A tile's merges, and what is left of its clusters: rows with ``v``."""
    def run(table: pa.Table) -> pa.Table:
        table, tile = _ordered(table)
        names, v = table.column("id"), pa.list_(pa.float64())
        x = np.stack(table.column("v").to_numpy()).astype(np.float64)
        (a, b, h, size), (ids, n, x) = _mean_merges(np.arange(len(x)), table.column("n").to_numpy().astype(np.float64), x, method, tile, threshold)
        done = pa.table([names.take(pa.array(a, pa.int64())), names.take(pa.array(b, pa.int64())), pa.array(h, pa.float64()), pa.array(size.astype(np.int64)),
                         pa.nulls(len(a), v)], names=["a", "b", "height", "size", "v"])
        rest = pa.table([names.take(pa.array(ids, pa.int64())), pa.nulls(len(ids), names.type), pa.nulls(len(ids), pa.float64()), pa.array(n.astype(np.int64)),
                         pa.array(list(x), v)], names=done.column_names)
        return pa.concat_tables([done, rest])
    return run


def _tiled(clusters: DataFrame, rows: int, turn: int, times: float = 1.0) -> DataFrame:
    """Clusters with the number ``_tile`` and the rim ``t0..t3`` of their tile: strips of the first coordinate, cut by the second; every
    second ``turn`` between the others, of ``times`` as many rows.  The driver holds the rims."""
    far, shift = float("inf"), 0.5 if turn % 2 else 0.0

    def cuts(n: int) -> list[float]:
        return [(i + shift) / n for i in range(n + 1) if 0 < (i + shift) / n < 1]
    x, y = F.col("v")[0], F.coalesce(F.get("v", F.lit(1)), F.lit(0.0))
    pts = clusters.withColumn("_x", F.nanvl(x, F.lit(0.0))).withColumn("_y", F.nanvl(y, F.lit(0.0)))
    strips = max(1, round((rows / (times * TILE)) ** 0.5))
    edges = sorted(set(pts.agg(F.percentile_approx("_x", cuts(strips), 1000)).first()[0])) if cuts(strips) else []
    strip = F.lit(0)
    for e in edges:
        strip = strip + (F.col("_x") >= e).cast("int")
    pts = pts.withColumn("_strip", strip)
    bounds = [-far, *edges, far]
    sizes = {r[0]: r[1] for r in pts.groupBy("_strip").count().collect()}
    grid = {s: cuts(int(-(-n // (times * TILE)))) for s, n in sizes.items()}
    most = sorted({c for g in grid.values() for c in g}) or [0.5]
    told = {r[0]: dict(zip(most, r[1])) for r in pts.groupBy("_strip").agg(F.percentile_approx("_y", most, 1000)).collect()}
    rims = []
    for s, g in grid.items():
        ys = [-far, *sorted({told[s][c] for c in g}), far]
        rims += [(s, len(rims) + i, bounds[s], bounds[s + 1], lo, hi) for i, (lo, hi) in enumerate(zip(ys[:-1], ys[1:]))]
    table = clusters.sparkSession.createDataFrame(rims, "_strip int, _tile int, t0 double, t1 double, t2 double, t3 double")
    return pts.join(F.broadcast(table), "_strip").filter((F.col("_y") >= F.col("t2")) & (F.col("_y") < F.col("t3"))).drop("_strip", "_x", "_y")


def _of_tiles(tiles: DataFrame, run, schema: str) -> DataFrame:
    return stored(spread(tiles, "_tile").groupBy("_tile").applyInArrow(lambda t: run(t), schema))


def _nearest_clusters(clusters: DataFrame, looking: DataFrame, method: str) -> DataFrame:
    """``(id, other, h)``: the nearest cluster, by linkage distance and name, of each of ``looking(id)``."""
    reps = clusters.select(F.lit(0).alias("g"), "id", "v", F.col("n").alias("mult"))
    grid = Grid(reps)
    near = _nearest(grid, F.lit(1), 1)
    side = [c.select(F.col("id").alias(i), F.col("n").alias(n), F.col("sq").alias(s)) for c, i, n, s in
            ((clusters, "q", "nq", "aq"), (clusters, "s", "ns", "bs"))]

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.join(side[0], "q").join(side[1], "s").select("q", "s", _distance(method, F.col("dist") * F.col("dist"), "nq", "ns", "aq", "bs").alias("h"))
    bound = linked(near).select(F.col("q").alias("id"), F.col("h").alias("u"))
    reach = clusters.join(bound, "id").select("id", (_radius(method) * (1 + 1e-9) + 1e-9).alias("_reach"))
    asking = stored(grid.points.join(looking, "id", "left_semi").join(reach, "id"))
    usual = asking.agg(F.percentile_approx("_reach", 0.5), F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()
    cell = max(float(usual[0] or 0.0), float(usual[1] or 0.0) / 4096, 1e-9)
    # of all pairs within reach (of means of cosine distances nearly all) only those that can be the nearest are handed on
    found = linked(grid.pairs_within(F.col("_reach"), F.lit(cell), asking, bounds=_bounds(method)).select("q", "s", "dist"))
    best = found.groupBy("q").agg(F.min(F.struct(F.round("h", 12).alias("r"), F.col("s"), F.col("h"))).alias("b"))
    return best.select(F.col("q").alias("id"), F.col("b.s").alias("other"), F.col("b.h").alias("h"))


def linkage_merges(points: DataFrame, id_col: str, vec_col: str, method: str = "ward", finish: int = NEAR_FINISH, threshold: float | None = None):
    """(merges ``(a, b, height, size)``, mapping ``(orig_id, id)``): cluster b joins cluster a, both named by their smallest member.

    ``ward``: Euclidean, heights as ``sqrt(2 n m / (n + m)) |difference of the means|``.  ``average``: the mean cosine
    distance of all pairs (a zero vector is at distance 1 from all).  Exact copies are one member of their number.
    With ``threshold`` only the merges below it.
    """
    if method not in ("ward", "average"):
        raise ValueError("ward or average; complete linkage is cut at a threshold")
    reps, mapping = dedupe_vectors(points, id_col, vec_col, normalize=method == "average")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    clusters = stored(reps.select("id", F.col("mult").alias("n"), "v").withColumn("sq", square))
    merges, near, turn = None, None, 0
    id_type = _id_type(clusters)
    run = _mean_rounds(method, threshold)
    schema = f"a {id_type}, b {id_type}, height double, size bigint, v array<double>"

    def merged_here(tiles: DataFrame):
        """Merges and clusters after each tile has merged what it can."""
        rows = _of_tiles(tiles, run, schema)
        done, rest = rows.filter("v is null").drop("v"), rows.filter("v is not null")
        return (done if merges is None else merges.unionByName(done)), rest.select(F.col("a").alias("id"), F.col("size").alias("n"), "v").withColumn("sq", square)
    left, wide = clusters.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    tiles_help = (wide or 0) <= 2
    while left > max(1, finish):
        before = left
        if tiles_help and left > TILE:
            merges, clusters = merged_here(_tiled(clusters, left, turn))
            near, turn, left = None, turn + 1, clusters.count()
            tiles_help = left < 0.8 * before
            continue
        looking = clusters.select("id")
        if near is not None:  # a nearest cluster that has not merged is still the nearest
            near = near.join(looking, "id", "left_semi").join(looking.withColumnRenamed("id", "other"), "other", "left_semi")
            near = near.join(merged, "id", "left_anti").join(merged.withColumnRenamed("id", "other"), "other", "left_anti")  # noqa: F821
            looking = looking.join(near, "id", "left_anti")
        fresh = _nearest_clusters(clusters, looking, method)
        if threshold is not None:  # a cluster without a partner below the threshold has none later, and is none
            fresh = fresh.filter(F.col("h") < threshold)
        near = stored(fresh if near is None else near.select(*fresh.columns).unionByName(fresh))
        back = near.select(F.col("id").alias("other"), F.col("other").alias("id"))
        pairs = stored(near.join(back, ["id", "other"]).filter("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"), F.col("h").alias("height")))
        if threshold is not None:
            clusters = clusters.join(near.select("id"), "id", "left_semi")
        if pairs.isEmpty():
            if threshold is not None and near.isEmpty():
                left = 0
                break
            raise RuntimeError("no reciprocal nearest neighbours")
        ab = pairs.join(clusters.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("v").alias("va")), "a") \
            .join(clusters.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("v").alias("vb")), "b")
        mean = F.zip_with("va", "vb", lambda x, y: (F.col("na") * x + F.col("nb") * y) / (F.col("na") + F.col("nb")))
        joined = ab.select(F.col("a").alias("id"), (F.col("na") + F.col("nb")).alias("n"), mean.alias("v"), "a", "b", "height")
        joined = stored(joined.withColumn("sq", square))
        done = joined.select("a", "b", "height", F.col("n").alias("size"))
        merges = done if merges is None else stored(merges.unionByName(done))
        merged = joined.select(F.col("a").alias("id"))
        gone = merged.unionByName(joined.select(F.col("b").alias("id")))
        clusters = stored(clusters.join(gone, "id", "left_anti").unionByName(joined.select(*clusters.columns)))
        left, tiles_help = clusters.count(), (wide or 0) <= 2
    if left > 1:  # at most ``finish`` rows
        everywhere = [F.lit(None).cast("double").alias(f"t{i}") for i in range(4)]
        merges, _ = merged_here(clusters.select("id", "n", "v", F.lit(0).alias("_tile"), *everywhere))
    if merges is None:
        merges = clusters.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("height"), F.col("n").alias("size")).filter("false")
    return merges, mapping


def _id_type(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def cut_merges(merges: DataFrame, mapping: DataFrame, n_clusters: int | None = None, threshold: float | None = None) -> DataFrame:
    """``(orig_id, cluster)``: the components of the merges below a height, or of all but the last ``n_clusters - 1``."""
    if (n_clusters is None) == (threshold is None):
        raise ValueError("either a number of clusters or a threshold")
    if threshold is not None:
        kept = merges.filter(F.col("height") < threshold)
    else:
        last = merges.orderBy(F.desc("height"), F.desc("size"), F.desc("b")).limit(n_clusters - 1).select("b")
        kept = merges.join(F.broadcast(last), "b", "left_anti") if n_clusters > 1 else merges
    ids = mapping.select("id").distinct()
    comp = connected_components(ids, kept.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return mapping.join(comp, "id").select("orig_id", F.col("component").alias("cluster"))


def _corners(x: np.ndarray) -> np.ndarray:
    """The members among which the farthest from any other point is: in the plane the corners of their hull (and what
    lies on its rim), else all."""
    if x.shape[1] != 2 or len(x) < 4:
        return x
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    inside, at = -1e-12 * float(np.ptp(x, axis=0).max()) ** 2, x.tolist()
    kept = set()
    for order in (range(len(at)), range(len(at) - 1, -1, -1)):
        chain: list[int] = []
        for n in order:
            while len(chain) > 1:
                (ox, oy), (ax, ay), (bx, by) = at[chain[-2]], at[chain[-1]], at[n]
                if (ax - ox) * (by - oy) - (ay - oy) * (bx - ox) >= inside:
                    break
                chain.pop()
            chain.append(n)
        kept.update(chain)
    return x[sorted(kept)]


def _member_rows(column: pa.Array) -> list[np.ndarray]:
    """A matrix of members for every row of an ``array<array<double>>`` column."""
    ends = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))
    rows = column.flatten()
    x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    return [x[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _farthest(batches):
    """The distance of the two farthest members of every pair of clusters."""
    for batch in batches:
        far = np.zeros(batch.num_rows)
        for n, (x, y) in enumerate(zip(_member_rows(batch.column("mq")), _member_rows(batch.column("ms")))):
            rows = max(1, CHUNK // len(y))
            far[n] = max(((x[a:a + rows, None] - y[None]) ** 2).sum(axis=2).max() for a in range(0, len(x), rows))
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("s"), pa.array(np.sqrt(far))], names=["q", "s", "dist"])


def _united(batches):
    """Merged pairs of clusters as clusters: a middle, how far a member lies from it, and the outer members."""
    for batch in batches:
        members = [_corners(np.concatenate(xy)) for xy in zip(_member_rows(batch.column("ma")), _member_rows(batch.column("mb")))]
        middles = [x.mean(axis=0) for x in members]
        rooms = [float(np.sqrt(((x - v) ** 2).sum(axis=1).max())) for x, v in zip(members, middles)]
        one = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array(middles, one), pa.array(rooms, pa.float64()),
                                          pa.array([list(x) for x in members], pa.list_(one))], names=["id", "v", "room", "members"])


def _between(d, room, a, n, b, m):
    """The farthest members of two clusters lie no nearer than the middles, and no farther than these and both rooms."""
    return d - room, d + room + n + m


def _farthest_candidates(clusters: DataFrame, looking: DataFrame, radius: float, room: float) -> DataFrame:
    """``(q, s, dist)``: clusters that can be the nearest of each of ``looking(id)`` within ``radius``, with their complete distance; ``room`` is the
    largest of all clusters."""
    id_type = _id_type(clusters)
    grid = Grid(clusters.select(F.lit(0).alias("g"), "id", "v", F.col("room").alias("mult")))
    # some cluster's middle lies within ``_r``, so its farthest member lies at most both rooms farther
    reach = F.least(F.col("_r") + F.col("mult") + room, F.lit(radius)) * (1 + 1e-9) + 1e-9
    asking = stored(grid.knn_radius(F.lit(1), 1).join(looking, "id", "left_semi").withColumn("_reach", reach))
    usual = asking.agg(F.percentile_approx("_reach", 0.5), F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()
    cell = max(float(usual[0] or 0.0), float(usual[1] or 0.0) / 4096, 1e-9)
    pairs = grid.pairs_within(F.col("_reach"), F.lit(cell), asking, bounds=_between).select("q", "s")
    for end, name in (("q", "mq"), ("s", "ms")):
        pairs = pairs.join(clusters.select(F.col("id").alias(end), F.col("members").alias(name)), end)
    return spread(pairs).mapInArrow(_farthest, f"q {id_type}, s {id_type}, dist double")


def _complete_rounds(threshold: float, metric: str):
    """All merges ``(a, b)`` of a tile's clusters, by a table of their distances: reciprocal nearest ones, round by round, that
    no cluster outside of the tile is nearer to; and what is left of the clusters of a tile: rows with ``v``."""
    measure = (lambda d: d * d / 2) if metric == "cosine" else (lambda d: d)

    def run(table: pa.Table) -> pa.Table:
        table, tile = _ordered(table)
        names, members = table.column("id"), _member_rows(table.column("members").combine_chunks())
        x, starts = np.concatenate(members), np.append(0, np.cumsum([len(m) for m in members])[:-1])
        d = np.empty((len(members), len(members)))
        for n, m in enumerate(members):
            far = np.zeros(len(x))
            for y in m:
                far = np.maximum(far, ((x - y) ** 2).sum(axis=1))
            d[n] = np.sqrt(np.maximum.reduceat(far, starts))
        d = measure(d)
        np.fill_diagonal(d, np.inf)
        d[d >= threshold] = np.inf
        middles, rows = np.stack(table.column("v").to_numpy()).astype(np.float64), np.arange(len(d))
        pairs, alive = [np.zeros((2, 0), int)], np.ones(len(d), bool)
        while True:
            near = np.round(d, 12).argmin(axis=1)  # the names are in order: the first of equals
            h = d[rows, near]
            # the farthest members of a cluster and one outside lie no nearer than its middle and the rim
            outside = measure(np.maximum(_edge(middles, tile), 0.0)) * (1 - 1e-9) - 1e-12
            sure = np.ones(len(d), bool) if tile is None else h < outside
            a = np.flatnonzero(np.isfinite(h) & (near[near] == rows) & (rows < near) & sure & sure[near])
            if not len(a):
                break
            b = near[a]
            pairs.append(np.stack([a, b]))
            d[a] = np.maximum(d[a], d[b])
            d[:, a] = np.maximum(d[:, a], d[:, b])
            d[b], d[:, b], d[a, a] = np.inf, np.inf, np.inf
            alive[b] = False
            if tile is not None:
                for i, j in zip(a, b):
                    members[i] = _corners(np.concatenate([members[i], members[j]]))
                    middles[i] = members[i].mean(axis=0)
        a, b = np.concatenate(pairs, axis=1)
        left = np.flatnonzero(alive & ~(~np.isfinite(h) & (outside >= threshold))) if tile is not None else rows[:0]
        one = pa.list_(pa.float64())
        rooms = [float(np.sqrt(((members[i] - middles[i]) ** 2).sum(axis=1).max())) for i in left]
        done = pa.table([names.take(pa.array(a)), names.take(pa.array(b)), pa.nulls(len(a), one), pa.nulls(len(a), pa.float64()),
                         pa.nulls(len(a), pa.list_(one))], names=["a", "b", "v", "room", "members"])
        rest = pa.table([names.take(pa.array(left)), pa.nulls(len(left), names.type), pa.array(list(middles[left]), one), pa.array(rooms, pa.float64()),
                         pa.array([list(members[i]) for i in left], pa.list_(one))], names=done.column_names)
        return pa.concat_tables([done, rest])
    return run


def complete_linkage(points: DataFrame, id_col: str, vec_col: str, threshold: float, metric: str = "cosine", finish: int = FINISH) -> DataFrame:
    """``(id, cluster)``: complete linkage cut at ``threshold`` (exclusive): no two members are that far apart.

    Ties go to the smaller names.  Label = smallest member.  In more than two dimensions a cluster is one row with all
    its distinct members, in the plane with the corners of their hull.
    """
    reps, mapping = dedupe_vectors(points, id_col, vec_col, normalize=metric == "cosine")
    radius = float(np.sqrt(2.0 * threshold)) if metric == "cosine" else float(threshold)
    h = F.col("dist") * F.col("dist") / 2 if metric == "cosine" else F.col("dist")
    clusters = reps
    if metric == "cosine":  # a zero vector is at distance 1 from all, not at half its length
        zero = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)) == 0
        if threshold > 1.0 and not reps.filter(zero).isEmpty():
            raise ValueError("a zero vector is within every threshold above 1: leave it out")
        clusters = reps.filter(~zero)
    clusters = stored(clusters.select("id", "v", F.lit(0.0).alias("room"), F.array("v").alias("members")))
    merges, near, turn, tiles_help = None, None, 0, True
    run, id_type = _complete_rounds(float(threshold), metric), _id_type(reps)

    def merged_here(tiles: DataFrame):
        """Merges and clusters after each tile has merged what it can."""
        rows = _of_tiles(tiles, run, f"a {id_type}, b {id_type}, v array<double>, room double, members array<array<double>>")
        done = rows.filter("v is null").select("a", "b")
        return (done if merges is None else merges.unionByName(done)), rows.filter("v is not null").drop("b").withColumnRenamed("a", "id")
    while True:
        left, held, room, wide = clusters.agg(F.count(F.lit(1)), F.sum(F.size("members")), F.max("room"), F.max(F.size("v"))).first()
        if left < 2 or (left <= finish and held <= 20 * finish):
            break
        if tiles_help and wide <= 2 and left > TILE:
            merges, clusters = merged_here(_tiled(clusters, left, turn))
            near, turn, tiles_help = None, turn + 1, clusters.count() < 0.8 * left
            continue
        tiles_help = True
        looking = clusters.select("id")
        if near is not None:  # a nearest cluster that has not merged is still the nearest
            near = near.join(merged, "id", "left_anti").join(merged.withColumnRenamed("id", "other"), "other", "left_anti")  # noqa: F821
            looking = looking.join(near, "id", "left_anti")
        found = _farthest_candidates(clusters, looking, radius, room).withColumn("h", h).filter(F.col("h") < threshold)
        best = found.groupBy("q").agg(F.min(F.struct(F.round("h", 12).alias("r"), F.least("q", "s").alias("x"), F.greatest("q", "s").alias("y"), F.col("s"))).alias("m"))
        fresh = best.select(F.col("q").alias("id"), F.col("m.s").alias("other"))
        near = stored(fresh if near is None else near.select("id", "other").unionByName(fresh))
        # the pair of least distance and names is the nearest of both its ends
        pairs = stored(near.join(near.select(F.col("id").alias("other"), F.col("other").alias("id")), ["id", "other"]).filter("id < other")
                       .select(F.col("id").alias("a"), F.col("other").alias("b")))
        # what has no partner within the threshold has none later
        clusters = clusters.join(near.select("id"), "id", "left_semi")
        if pairs.isEmpty():
            if not near.isEmpty():
                raise RuntimeError("no reciprocal nearest neighbours")
            break
        merges = pairs if merges is None else merges.unionByName(pairs)
        merged = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
        both = pairs
        for end, name in (("a", "ma"), ("b", "mb")):
            both = both.join(clusters.select(F.col("id").alias(end), F.col("members").alias(name)), end)
        joined = spread(both).mapInArrow(_united, f"id {_id_type(reps)}, v array<double>, room double, members array<array<double>>")
        clusters = stored(clusters.join(merged, "id", "left_anti").unionByName(joined))
    if left > 1 and left <= finish:
        everywhere = [F.lit(None).cast("double").alias(f"t{i}") for i in range(4)]
        merges, _ = merged_here(clusters.select("*", F.lit(0).alias("_tile"), *everywhere))
    if merges is None:
        return mapping.select(F.col("orig_id").alias(id_col), F.col("id").alias("cluster"))
    comp = connected_components(reps.select("id"), merges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return mapping.join(comp, "id").select(F.col("orig_id").alias(id_col), F.col("component").alias("cluster"))
