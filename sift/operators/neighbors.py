"""Exact neighbour joins: grid cells joined as packed blocks, verified by matrix products.

Two orthonormal projections of a vector (the scaled sums of its even and of its
odd coordinates) never lie farther apart than the vectors themselves, so points
within ``r`` of each other lie in grid cells at most ``r`` apart.  A point asks
the cells of its square of half side ``r``; the points of a cell are packed into
blocks of about ``WIDE`` rows, and the equi-join on the cell meets blocks, not
points: (cell size / WIDE)^2 rows, verified by NumPy products where they are joined
(pairs of blocks are never shuffled), and only pairs within the radius leave the task.  Cells form levels, four times as wide each:
a point of a wide radius asks on a coarser level, so a far outlier asks as few
cells as any other point.  A crowded cell is many blocks, so no
key holds more than a block in one row, and its blocks are dealt to at most ``PARTS``
parts on either side, whose pairs are dealt over all tasks: a row is shuffled ``PARTS``
times at most, however crowded its cell.  Pairs that pass the product are measured again by differences.

* range join (J9, density): radius eps, cells of side eps;
* k-NN join (J8, LOF): a bound on the k-th distance comes from a point's own
  block, on grids that get coarser until every point has one; then a range join
  with that bound as each point's radius, keeping the k best per task and block.

On data that fills its space evenly in many dimensions no cell prunes; reduce
first (:mod:`sift.operators.reduce`), as the topic pipeline does.  Exact copies are
collapsed first to ``(vector, multiplicity)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

from sift.operators.topn import top_n_per_group
from sift.session import bounded_batches, cut_lineage, spread, stored

BLOCK = 256  # of a point's own block, which bounds its k-th distance
WIDE = 2048  # of the blocks that are compared
PARTS = 8
CHUNK = 1 << 16  # pairs measured at once
SLACK = 1e-6  # of the products; pairs are measured exactly afterwards
BIG = 1e300
REACH = 4  # cells that a radius may span before the next level is asked


def euclid(a, b) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _rows(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return values.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False)))


@arrow_udf(ArrayType(DoubleType()))
def _unit(values: pa.Array) -> pa.Array:
    flat, offs = _rows(values)
    size = np.diff(offs)
    n = np.sqrt(np.array([np.dot(flat[a:b], flat[a:b]) for a, b in zip(offs[:-1], offs[1:])]))
    n[n == 0] = 1.0
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat / np.repeat(n, size)))


def unit(a) -> Column:
    """The vector at length 1; a zero vector stays zero (it is at distance 1 from every unit vector)."""
    return _unit((F.col(a) if isinstance(a, str) else a).cast("array<double>"))


def dedupe_vectors(points: DataFrame, id_col: str, vec_col: str, normalize: bool = False,
                   group_col: str | None = None):
    """Collapse exact copies (within a group): returns ``(reps, mapping)``.

    ``reps``: ``(g, id, v array<double>, mult)`` with ``id`` = smallest member id;
    ``mapping``: ``(orig_id, id)``.  Rows with a null vector take no part.
    Grouping by the vector is a hash aggregate with map-side combine, so a hot
    copy group never reaches one task whole; the mapping join is a
    fact-to-dimension join on the vector, which AQE splits when one vector is hot.
    """
    v = F.col(vec_col).cast("array<double>")
    g = F.col(group_col) if group_col else F.lit(0)
    # the input is read by several jobs (sizes, cells, mapping): materialise it once
    pts = points.filter(F.col(vec_col).isNotNull())
    pts = cut_lineage(pts.select(g.alias("g"), F.col(id_col).alias("orig_id"), (unit(v) if normalize else v).alias("v")))
    reps = cut_lineage(pts.groupBy("g", "v").agg(F.min("orig_id").alias("id"), F.count(F.lit(1)).alias("mult")))
    mapping = pts.join(reps.select("g", "v", "id"), (pts["g"].eqNullSafe(reps["g"])) & (pts["v"] == reps["v"])) \
        .select("orig_id", "id")
    return reps.select("g", "id", "v", "mult"), mapping


def _plane(v: str) -> tuple[Column, Column]:
    """Two orthonormal projections: scaled sums of the even and of the odd coordinates."""
    def part(odd):
        kept = F.filter(F.col(v), lambda x, i: i % 2 == odd)
        return F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.sqrt(F.greatest(F.size(kept), F.lit(1)))
    return part(0), part(1)


class Grid:
    """Distinct points ``(g, id, v, mult)`` with their plane coordinates and group sizes."""

    def __init__(self, reps: DataFrame):
        x, y = _plane("v")
        pts = reps.select("g", "id", "v", "mult", x.alias("x"), y.alias("y"))
        size = pts.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("mult").alias("n_all"),
                                    F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        self.points = cut_lineage(pts.join(size, pts["g"].eqNullSafe(size["g"])).drop(size["g"]))

    # -------------------------------------------------------------- packing
    @staticmethod
    def _packed(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
        """Blocks of about BLOCK rows per key: ``(keys, name array<struct>)``."""
        sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_b"))
        salted = rows.join(sizes, keys).withColumn("_s", F.pmod(F.xxhash64("id"), F.col("_b")))
        return salted.groupBy(*keys, "_s").agg(F.collect_list(value).alias(name)).drop("_s")

    def asked(self, radius: Column, side: Column, points: DataFrame | None = None) -> DataFrame:
        """Points with the cells that their radius reaches: ``(.., _r, _g, _level, cx, cy)``.

        Cells of level L are 4**L sides wide.  A point asks on the first level where its radius is at most
        ``REACH`` cells, so it asks at most ``(2 * REACH + 1)**2`` cells however far it lies from the others.
        """
        rows = (points if points is not None else self.points).withColumn("_r", radius).withColumn("_side", side) \
            .withColumn("_g", F.coalesce(F.col("g").cast("string"), F.lit("\0")))
        span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
        cells = F.least("_r", span) / (REACH * F.col("_side"))
        rows = rows.withColumn("_level", F.when(cells > 1, F.ceil(F.log(4.0, cells))).otherwise(0).cast("int"))
        wide = F.col("_side") * F.pow(F.lit(4.0), F.col("_level"))
        low = lambda c, a: F.floor((F.greatest(F.col(c) - F.col("_r"), F.col(a)) - F.col(a)) / wide)
        high = lambda c, a, b: F.floor((F.least(F.col(c) + F.col("_r"), F.col(b)) - F.col(a)) / wide)
        return (rows.withColumn("cx", F.explode(F.sequence(low("x", "x0"), high("x", "x0", "x1"))))
                .withColumn("cy", F.explode(F.sequence(low("y", "y0"), high("y", "y0", "y1")))))

    def _members(self, side: Column, levels: list[int]) -> DataFrame:
        """The points in their cells of every level that is asked."""
        rows = self.points.withColumn("_g", F.coalesce(F.col("g").cast("string"), F.lit("\0"))).withColumn("_side", side)
        rows = rows.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels])))
        wide = F.col("_side") * F.pow(F.lit(4.0), F.col("_level"))
        return rows.withColumn("cx", F.floor((F.col("x") - F.col("x0")) / wide)).withColumn("cy", F.floor((F.col("y") - F.col("y0")) / wide))

    def pairs_within(self, radius: Column, side: Column, points: DataFrame | None = None, keep: int | None = None,
                     forest: bool = False, counts: bool = False, bounds=None) -> DataFrame:
        """``(q, s, dist, s_mult)`` of every ordered pair in one group with ``q != s`` and ``dist <= radius(q)``.

        ``side``: the smallest cells' side, the same for all rows of a group.  ``keep``: of a
        left block only the best ``keep`` per ``q`` leave the task.  ``forest``: only
        edges that join what the block pair has not joined yet (for components).  ``counts``: ``(q, nb)``
        instead, parts of the sums of ``s_mult``.  ``bounds(d, room, lengths and mult of q, of s)``: a lower and an upper
        bound of a measure; only pairs that can be the least of ``q`` among those that its left block has met leave the task.
        """
        asked = self.asked(radius, side, points)
        # a level for every factor of 4 between the radii: a handful
        levels = [r[0] for r in asked.select("_level").distinct().collect()] or [0]
        members = self._members(side, levels)
        keys = ["_g", "_level", "cx", "cy"]
        id_type = self.points.schema["id"].dataType.simpleString()
        met = met_blocks(asked.select(*keys, "id", "v", F.col("_r").alias("r"), *(["mult"] if bounds else [])), members.select(*keys, "id", "v", "mult"), keys)
        if counts:
            return met.mapInArrow(_counted, f"q {id_type}, nb bigint")
        mult_type = self.points.schema["mult"].dataType.simpleString()
        return met.mapInArrow(_verified(keep, forest, bounds), f"q {id_type}, s {id_type}, dist double, s_mult {mult_type}")

    def knn_radius(self, k: Column, k_max: int) -> DataFrame:
        """Points with ``_k`` (their group's k) and ``_r``, a bound on the k-th distance to distinct others."""
        span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
        pts = self.points.withColumn("_k", k).withColumn("_g", F.coalesce(F.col("g").cast("string"), F.lit("\0")))
        side = F.greatest(span / F.greatest(F.lit(1.0), F.sqrt(F.col("n") / (8.0 * (k_max + 1)))), F.lit(1e-9))
        open_ = pts.filter((F.col("_k") > 0) & (F.col("n") > F.col("_k")))
        found = None
        level = 1.0
        id_type = self.points.schema["id"].dataType.simpleString()
        cells = ["_g", "cx", "cy"]
        while True:
            cell = side * level
            rows = pts if found is not None else open_
            rows = rows.withColumn("cx", F.floor((F.col("x") - F.col("x0")) / cell)).withColumn("cy", F.floor((F.col("y") - F.col("y0")) / cell))
            if found is not None:  # points without a bound look at all points of a wider cell; the others ask for nothing
                rows = rows.join(open_.select("id", F.lit(True).alias("_open")), "id", "left")
                rows = rows.join(rows.filter("_open").select(*cells).distinct(), cells, "left_semi")
                rows = rows.withColumn("_k", F.when(F.col("_open"), F.col("_k")).otherwise(F.lit(2**31 - 1)))
            packed = self._packed(rows.select(*cells, "id", "v", "_k"), cells, F.struct("id", "v", F.col("_k").alias("k")), "l")
            got = stored(spread(packed.select("l")).mapInArrow(_own_block, f"id {id_type}, _r double"))
            found = got if found is None else found.unionByName(got)
            left = open_.join(got, "id", "left_anti")
            # a grid whose only cell is one block answers for all of its group; else look wider
            if left.isEmpty():
                break
            if level > 4 ** 12:  # one cell a group, and its blocks still too small: every distance bounds it
                break
            open_, level = stored(left), level * 4
        return cut_lineage(pts.drop("_g").join(found, "id", "left").withColumn("_r", F.coalesce("_r", F.lit(BIG))))


def met_blocks(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``(b, l, m)``: the pairs of blocks of ``left(keys, id, ..)`` and ``right(keys, id, ..)`` of one key, made where
    they are joined; ``b`` names the left block, whose pairs follow each other in a task."""
    bounded_batches(left.sparkSession)
    sizes = [rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / WIDE).cast("int").alias(n)) for rows, n in ((left, "_bl"), (right, "_bm"))]
    both = sizes[0].join(sizes[1], keys)

    def dealt(rows: DataFrame, own: str, other: str, name: str) -> DataFrame:
        parts = {n: F.least(F.lit(PARTS), F.col(n)) for n in (own, other)}
        value = F.struct(*[c for c in rows.columns if c not in keys])
        rows = rows.join(both, keys).withColumn("_s", F.pmod(F.xxhash64("id"), F.col(own)))
        blocks = rows.groupBy(*keys, "_s", own, other).agg(F.collect_list(value).alias(name))
        return blocks.select(*keys, "_s", name, (F.col("_s") % parts[own]).alias("_own"),
                             F.explode(F.sequence(F.lit(0), parts[other] - 1)).alias("_other"))
    at = [*keys, "_i", "_j"]
    l = dealt(left, "_bl", "_bm", "l").select(*keys, F.xxhash64(*keys, "_s").alias("b"), "l", F.col("_own").cast("int").alias("_i"), F.col("_other").alias("_j"))
    m = dealt(right, "_bm", "_bl", "m").select(*keys, "m", F.col("_own").cast("int").alias("_j"), F.col("_other").alias("_i"))
    return spread(l, *at).join(spread(m, *at), at).select("b", "l", "m")


def _matrix(column: pa.Array, field: str) -> np.ndarray:
    v = column.field(field)
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0.0))


class _Side:
    """A block's ids as NumPy and Arrow, its vectors, and what else it holds."""

    def __init__(self, block: pa.Array):
        self.names, self.v = block.field("id"), _matrix(block, "v")
        self.ids = self.names.to_numpy(zero_copy_only=False)
        self.length = np.sqrt((self.v * self.v).sum(axis=1))
        self.block = block

    def numbers(self, field: str) -> np.ndarray:
        return self.block.field(field).to_numpy().copy()


def _near(l: _Side, m: _Side, r: np.ndarray):
    """For some left rows at a time: first row, rough distances (infinite for a row itself), radii and room for the roughness."""
    rows = max(1, CHUNK // max(1, len(m.ids)))
    longest = m.length.max(initial=0.0)
    for a in range(0, len(l.ids), rows):
        part = slice(a, a + rows)
        d = _distances(l.v[part], m.v)
        d[l.ids[part][:, None] == m.ids[None, :]] = np.inf
        room = SLACK * np.maximum(np.maximum(1.0, np.minimum(r[part], 1e6)), l.length[part] + longest)
        yield a, d, r[part], room


def _measured(l: _Side, m: _Side, i, j):
    return np.sqrt(((l.v[i] - m.v[j]) ** 2).sum(axis=1))


def _within(l: _Side, m: _Side, r: np.ndarray, keep: int | None):
    """(left rows, right rows, distances) of the pairs within the radii, some left rows at a time; with ``keep`` a few
    more than the ``keep`` nearest of each."""
    for a, d, radius, room in _near(l, m, r):
        far = radius + room
        if keep is not None and keep < d.shape[1]:
            far = np.minimum(far, np.partition(d, keep - 1, axis=1)[:, keep - 1] + 2 * room)
        i, j = np.nonzero((d <= far[:, None]) & np.isfinite(d))
        for n in range(0, len(i), CHUNK):
            x, y = i[n:n + CHUNK] + a, j[n:n + CHUNK]
            dist = _measured(l, m, x, y)
            ok = dist <= r[x] + 1e-9
            yield x[ok], y[ok], dist[ok]


def _linked(l: _Side, m: _Side, r: np.ndarray) -> np.ndarray:
    """Which pairs are within the radii; only those near the radius are measured by differences."""
    out = np.zeros((len(l.ids), len(m.ids)), bool)
    for a, d, radius, room in _near(l, m, r):
        part = out[a:a + len(d)]
        part[:] = d <= (radius - room)[:, None]
        i, j = np.nonzero((d <= (radius + room)[:, None]) & ~part & np.isfinite(d))
        for n in range(0, len(i), CHUNK):
            x, y = i[n:n + CHUNK], j[n:n + CHUNK]
            part[x, y] = _measured(l, m, x + a, y) <= radius[x] + 1e-9
    return out


class _Best:
    """The ``keep`` nearest of every row of a left block, of the right blocks that it has met."""

    def __init__(self, l: _Side, keep: int):
        self.l, self.keep, self.r = l, keep, l.numbers("r")
        self.i, self.s, self.dist, self.mult = np.zeros(0, int), l.ids[:0], np.zeros(0), np.zeros(0, np.int64)

    def meet(self, m: _Side) -> None:
        got = list(_within(self.l, m, self.r, self.keep))
        if not got:
            return
        i, j, dist = (np.concatenate(c) for c in zip(*got))
        if not len(i):
            return
        i, s = np.concatenate([self.i, i]), np.concatenate([self.s, m.ids[j]])
        dist, mult = np.concatenate([self.dist, dist]), np.concatenate([self.mult, m.numbers("mult")[j]])
        order = np.lexsort((s, np.round(dist, 12), i))
        i, s, dist, mult = i[order], s[order], dist[order], mult[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        last = rank == self.keep - 1
        self.r[i[last]] = np.minimum(self.r[i[last]], dist[last])  # nothing farther is of use
        best = rank < self.keep
        self.i, self.s, self.dist, self.mult = i[best], s[best], dist[best], mult[best]

    def rows(self, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.l.names.take(pa.array(self.i)), pa.array(self.s, self.l.names.type), pa.array(self.dist),
                                           pa.array(self.mult, pa.int64())], names=names)


def _met(batches):
    """(left block's name, its side, right side) of every block pair; the left side is read once for pairs that follow each other."""
    name, l = None, None
    for batch in batches:
        for n in range(batch.num_rows):
            b = batch.column("b")[n].as_py()
            if b != name:
                name, l = b, _Side(batch.column("l")[n].values)
            yield b, l, _Side(batch.column("m")[n].values)


def _least(l: _Side, m: _Side, r: np.ndarray, best: np.ndarray, bounds):
    """As ``_within``, but only pairs whose lower bound is at most the least upper bound of their left row, kept in ``best``."""
    sides = [(x.length, x.numbers("mult").astype(np.float64)) for x in (l, m)]
    for a, d, radius, room in _near(l, m, r):
        part = slice(a, a + len(d))
        low, high = bounds(d, room[:, None], sides[0][0][part, None], sides[0][1][part, None], sides[1][0][None], sides[1][1][None])
        inside = (d <= (radius + room)[:, None]) & np.isfinite(d)
        # a pair on the rim may lie outside: it bounds nothing
        sure = (d <= (radius - room)[:, None]) & inside
        best[part] = np.minimum(best[part], np.where(sure, high, np.inf).min(axis=1, initial=np.inf))
        i, j = np.nonzero(inside & (low <= best[part, None]))
        for n in range(0, len(i), CHUNK):
            x, y = i[n:n + CHUNK] + a, j[n:n + CHUNK]
            dist = _measured(l, m, x, y)
            ok = dist <= r[x] + 1e-9
            yield x[ok], y[ok], dist[ok]


def _verified(keep: int | None, forest: bool, bounds=None):
    names = ["q", "s", "dist", "s_mult"]

    def pairs(l: _Side, m: _Side, i, j, dist) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([l.names.take(pa.array(i)), m.names.take(pa.array(j)), pa.array(dist),
                                           m.block.field("mult").take(pa.array(j))], names=names)

    def run(batches):
        best, here, least = None, None, None
        for b, l, m in _met(batches):
            if bounds is not None:
                if b != here:
                    least, here = np.full(len(l.ids), np.inf), b
                for i, j, dist in _least(l, m, l.numbers("r"), least, bounds):
                    yield pairs(l, m, i, j, dist)
            elif keep is not None:
                if b != here:
                    if best is not None:
                        yield best.rows(names)
                    best, here = _Best(l, keep), b
                best.meet(m)
            elif forest:
                i, j = _forest(_linked(l, m, l.numbers("r")))
                yield pairs(l, m, i, j, _measured(l, m, i, j))
            else:
                for i, j, dist in _within(l, m, l.numbers("r"), None):
                    yield pairs(l, m, i, j, dist)
        if best is not None:
            yield best.rows(names)
    return run


def _counted(batches):
    for _, l, m in _met(batches):
        nb = _linked(l, m, l.numbers("r")).astype(np.float64) @ m.numbers("mult").astype(np.float64)
        at = np.flatnonzero(nb)
        yield pa.RecordBatch.from_arrays([l.names.take(pa.array(at)), pa.array(nb[at].astype(np.int64))], names=["q", "nb"])


def _forest(linked: np.ndarray):
    """Edges (left rows, right rows) of a spanning forest of a block pair's links, breadth first."""
    left, right = linked.any(axis=1), linked.any(axis=0)
    i, j = [], []
    while left.any():
        rows = np.flatnonzero(left)[:1]
        left[rows] = False
        while len(rows):
            new = np.flatnonzero(right)
            new = new[linked[np.ix_(rows, new)].any(axis=0)]
            right[new] = False
            i.append(rows[linked[np.ix_(rows, new)].argmax(axis=0)])
            j.append(new)
            rows = np.flatnonzero(left)
            if not len(new):
                break
            rows = rows[linked[np.ix_(rows, new)].any(axis=1)]
            left[rows] = False
            i.append(rows)
            j.append(new[linked[np.ix_(rows, new)].argmax(axis=1)])
    none = np.zeros(0, int)
    return np.concatenate([*i, none]), np.concatenate([*j, none])


def _own_block(batches):
    """The k-th distance inside a point's own block, where the block has k others."""
    for batch in batches:
        for n in range(batch.num_rows):
            l = batch.column("l")[n].values
            v, k = _matrix(l, "v"), l.field("k").to_numpy()
            at = np.flatnonzero(k < len(v))
            if not len(at):
                continue
            d = _distances(v[at], v)
            d[np.arange(len(at)), at] = np.inf
            d.sort(axis=1)
            bound = d[np.arange(len(at)), k[at] - 1]
            yield pa.RecordBatch.from_arrays([l.field("id").take(pa.array(at)), pa.array(bound + SLACK * np.maximum(1.0, bound))], names=["id", "_r"])


def _nearest(grid: Grid, k: Column, k_max: int) -> DataFrame:
    """``(q, s, dist, s_mult, rank)``: the k nearest distinct other points of each point (all, if fewer)."""
    pts = grid.knn_radius(k, k_max)
    # cells of the usual radius; wider ones ask on coarser levels
    usual = pts.filter(F.col("_r") < BIG).groupBy("g").agg(F.percentile_approx("_r", 0.5).alias("_usual"))
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9))
    with_side = pts.join(usual.withColumnRenamed("g", "_h"), F.col("g").eqNullSafe(F.col("_h")), "left").drop("_h") \
        .withColumn("_cell", F.greatest(F.coalesce("_usual", span), span / 4096))
    grid.points = cut_lineage(with_side)
    pairs = grid.pairs_within(F.col("_r"), F.col("_cell"), grid.points.filter(F.col("_k") > 0), keep=k_max)
    ranked = top_n_per_group(pairs.withColumn("_d", F.round("dist", 12)), ["q"], [F.asc("_d"), F.asc("s")], k_max, salt_cols=["s"])
    return ranked.drop("_d")


def knn(points: DataFrame, id_col: str, vec_col: str, k: int, normalize: bool = False) -> DataFrame:
    """Exact k nearest neighbours (Euclidean; cosine order with ``normalize``).

    Returns ``(q, s, dist, rank)`` for every row, ties by neighbour id.  Exact
    copies are neighbours at distance 0.  A row with fewer than ``k`` others has
    all of them.  Only the first ``k + 1`` ids of a copy group can be neighbours,
    so a hot group is never expanded into pairs.
    """
    reps, mapping = dedupe_vectors(points, id_col, vec_col, normalize)
    return with_copies(_nearest(Grid(reps), F.lit(k), k).select("q", "s", "dist"), reps, mapping, k)


def with_copies(near: DataFrame, reps: DataFrame, mapping: DataFrame, k: int) -> DataFrame:
    """Neighbours ``(q, s, dist)`` of distinct vectors -> those of all rows, copies at distance 0 included."""
    near = near.unionByName(reps.select(F.col("id").alias("q"), F.col("id").alias("s"), F.lit(0.0).alias("dist")))
    first = top_n_per_group(mapping, ["id"], [F.asc("orig_id")], k + 1, salt_cols=["orig_id"]) \
        .select(F.col("id").alias("s"), F.col("orig_id").alias("n"))
    listed = top_n_per_group(near.join(first, "s").withColumn("_d", F.round("dist", 12)).select("q", "n", "dist", "_d"), ["q"],
                             [F.asc("_d"), F.asc("n")], k + 1, salt_cols=["n"])
    mine = mapping.withColumnRenamed("id", "q").join(listed.select("q", "n", "dist", F.col("rank").alias("_r")), "q") \
        .filter(F.col("n") != F.col("orig_id"))
    return top_n_per_group(mine.select(F.col("orig_id").alias("q"), F.col("n").alias("s"), "dist", "_r"), ["q"],
                           [F.asc("_r")], k, salt_cols=["s"]).drop("_r")


def local_outlier_factor(points: DataFrame, id_col: str, vec_col: str, k: int = 20,
                         contamination: float = 0.15, normalize: bool = False, group_col: str | None = None) -> DataFrame:
    """M6 + W9 (+ M7 with ``group_col``): LOF with ``min(k, rows of the group - 1)`` neighbours
    per point (self excluded, copies included), ``lrd = 1 / (mean reach-dist + 1e-10)``,
    ``lof = mean lrd(nb) / lrd``; a point is an outlier when ``-lof`` is below the
    linearly interpolated ``contamination`` percentile of its group.
    Returns ``(id, lof, is_inlier)`` for every input row with a vector; the only row
    of a group has a null score and is an inlier.
    """
    reps, mapping = dedupe_vectors(points, id_col, vec_col, normalize, group_col)
    grid = Grid(reps)
    kg = F.least(F.lit(k), F.col("n_all") - 1).cast("int")
    # of k_g neighbours with copies at most min(k_g, other distinct points) are distinct
    near = _nearest(grid, F.least(kg, F.col("n") - 1).cast("int"), k)
    info = cut_lineage(grid.points.select("g", F.col("id").alias("q"), "mult", kg.alias("k")))
    best = near.select("q", "s", "dist", F.col("s_mult").alias("avail"), F.round("dist", 12).alias("_d"))
    selfc = info.filter(F.col("mult") > 1).select("q", F.col("q").alias("s"), F.lit(0.0).alias("dist"),
                                                  (F.col("mult") - 1).alias("avail"), F.lit(-1.0).alias("_d"))
    from pyspark.sql import Window
    w = Window.partitionBy("q").orderBy("_d", "s")  # at most k + 1 rows per q
    cand = best.unionByName(selfc).join(info.select("q", "k"), "q")
    cand = cand.withColumn("_before", F.coalesce(F.sum("avail").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nb = cand.withColumn("w", F.least(F.col("avail"), F.col("k") - F.col("_before"))).filter(F.col("w") > 0)
    nb = cut_lineage(nb.select("q", "s", "dist", "w", "k"))
    kd = nb.groupBy("q").agg(F.max("dist").alias("kdist"))
    reach = nb.join(kd.withColumnRenamed("q", "s"), "s").withColumn("rd", F.greatest("dist", "kdist"))
    lrd = reach.groupBy("q").agg((F.lit(1.0) / (F.sum(F.col("w") * F.col("rd")) / F.max("k") + F.lit(1e-10))).alias("lrd"))
    ratio = nb.join(lrd.withColumnRenamed("q", "s").withColumnRenamed("lrd", "lrd_s"), "s") \
              .groupBy("q").agg((F.sum(F.col("w") * F.col("lrd_s")) / F.max("k")).alias("mean_lrd"))
    lof = ratio.join(lrd, "q").select("q", (F.col("mean_lrd") / F.col("lrd")).alias("lof"))
    lof = cut_lineage(info.join(lof, "q", "left").withColumn("neg", -F.col("lof")))
    from sift.operators.stats import group_quantile
    cuts = group_quantile(lof, "g", "neg", contamination, "mult")
    if group_col is None:
        cut = cuts.first()  # one number: no join on a constant
        flag = F.coalesce(F.col("neg") >= F.lit(cut["q"] if cut else None).cast("double"), F.lit(True))
        res = lof.select("q", "lof", flag.alias("is_inlier"))
    else:
        cuts = cuts.select(F.col("g").alias("_h"), F.col("q").alias("c"))
        res = lof.join(cuts, F.col("g").eqNullSafe(F.col("_h")), "left") \
                 .select("q", "lof", F.coalesce(F.col("neg") >= F.col("c"), F.lit(True)).alias("is_inlier"))
    return mapping.join(res.withColumnRenamed("q", "id"), "id").select(F.col("orig_id").alias(id_col), "lof", "is_inlier")


def local_outlier_factor_by_group(points: DataFrame, group_col: str, id_col: str, vec_col: str, k: int = 20,
                                  contamination: float = 0.15, normalize: bool = False) -> DataFrame:
    """M7: LOF inside every group (e.g. per question) as one job: the group key is
    part of the copy key, the cell key and the percentile cut."""
    lof = local_outlier_factor(points, id_col, vec_col, k, contamination, normalize, group_col=group_col)
    return lof.join(points.select(id_col, group_col), id_col)
