"""Neighbour jobs against brute force on fixtures with exact copies (a third of
the rows), a far outlier and two chains that touch."""

import numpy as np

from sift.operators.cluster import density_clusters, single_linkage
from sift.operators.graph import connected_components
from sift.operators.neighbors import local_outlier_factor


def fixture(seed=3):
    rng = np.random.default_rng(seed)
    pts = rng.normal(size=(60, 4))
    pts[:30] = pts[0]                      # 30 exact copies of one vector (a third of 90)
    extra = rng.normal(size=(29, 4)) * 0.3 + 2.0
    far = np.full((1, 4), 25.0)            # far outlier
    return np.vstack([pts, extra, far])


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)],
                                 "id long, v array<double>")


def brute_lof(x, k, contamination):
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    nbrs = []
    for i in range(n):
        order = sorted((d[i, j], j) for j in range(n) if j != i)
        nbrs.append([j for _, j in order[:k]])
    kd = np.array([d[i, nbrs[i][-1]] for i in range(n)])
    lrd = np.array([1.0 / (np.mean([max(kd[j], d[i, j]) for j in nbrs[i]]) + 1e-10) for i in range(n)])
    lof = np.array([np.mean(lrd[nbrs[i]]) / lrd[i] for i in range(n)])
    cut = np.percentile(-lof, 100 * contamination)
    return lof, (-lof >= cut)


def test_lof_with_copies_matches_brute_force(spark):
    x = fixture()
    got = {r.id: (r.lof, r.is_inlier) for r in local_outlier_factor(frame(spark, x), "id", "v", 5, 0.1).collect()}
    lof, inl = brute_lof(x, 5, 0.1)
    assert len(got) == len(x)
    for i in range(len(x)):
        assert abs(got[i][0] - lof[i]) < 1e-6 * max(1.0, lof[i]), (i, got[i], lof[i])
        assert got[i][1] == bool(inl[i])
    assert got[len(x) - 1][1] is False      # the far outlier


def union_find(n, edges):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return [min(j for j in range(n) if find(j) == find(i)) for i in range(n)]


def test_single_linkage_matches_brute_force(spark):
    x = fixture()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cd = 1 - u @ u.T
    n = len(x)
    edges = [(i, j) for i in range(n) for j in range(i + 1, n) if cd[i, j] < 0.05]
    want = union_find(n, edges)
    got = {r.id: r.cluster for r in single_linkage(frame(spark, x), "id", "v", 0.05).collect()}
    assert [got[i] for i in range(n)] == want


def test_density_clusters_match_brute_force(spark):
    x = fixture()
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    eps, ms, mcs = 0.6, 4, 5
    core = [(d[i] <= eps).sum() >= ms for i in range(n)]
    edges = [(i, j) for i in range(n) for j in range(i + 1, n) if core[i] and core[j] and d[i, j] <= eps]
    comp = union_find(n, edges)
    want = []
    for i in range(n):
        if not core[i]:
            want.append(-1)
            continue
        size = sum(1 for j in range(n) if core[j] and comp[j] == comp[i])
        want.append(comp[i] if size >= mcs else -1)
    got = {r.id: r.cluster for r in density_clusters(frame(spark, x), "id", "v", eps, ms, mcs).collect()}
    assert [got[i] for i in range(n)] == want


def test_connected_components_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, n - 1) if i != 99], "src long, dst long")
    verts = spark.range(n).select("id")
    got = {r.id: r.component for r in connected_components(verts, edges).collect()}
    assert all(got[i] == (0 if i < 100 else 100) for i in range(n))


def brute_knn(x, ids, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    out = {}
    for i, a in enumerate(ids):
        order = sorted((round(float(d[i, j]), 9), b) for j, b in enumerate(ids) if j != i)
        out[a] = [b for _, b in order[:k]]
    return out


def test_knn_keeps_copies(spark):
    from sift.operators.neighbors import knn
    x = fixture()
    want = brute_knn(x, list(range(len(x))), 7)
    got = {}
    for r in knn(frame(spark, x), "id", "v", 7).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.s)
    assert got == want


def test_knn_of_few_rows(spark):
    from sift.operators.neighbors import knn
    x = np.array([[0.0, 0.0], [1.0, 0.0], [5.0, 0.0]])
    got = {(r.q, r["rank"]): r.s for r in knn(frame(spark, x), "id", "v", 10).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (1, 1): 0, (1, 2): 2, (2, 1): 1, (2, 2): 0}
    assert knn(frame(spark, x[:1]), "id", "v", 3).count() == 0
    assert knn(frame(spark, x[:0]), "id", "v", 3).count() == 0


def test_small_groups_leave_others_unchanged(spark):
    rng = np.random.default_rng(8)
    big = [("a", i, [float(z) for z in rng.normal(size=3)]) for i in range(30)]
    schema = "g string, id long, v array<double>"
    alone = {r.id: r.lof for r in local_outlier_factor(spark.createDataFrame(big, schema), "id", "v", 8, 0.2, group_col="g").collect()}
    more = big + [("b", 100, [1.0, 2.0, 3.0]), ("b", 101, [1.0, 2.0, 4.0]), ("c", 200, [0.0, 0.0, 0.0]), (None, 300, [1.0, 1.0, 1.0]),
                  (None, 301, [2.0, 1.0, 1.0]), (None, 302, [2.0, 5.0, 1.0])]
    got = {r.id: r for r in local_outlier_factor(spark.createDataFrame(more, schema), "id", "v", 8, 0.2, group_col="g").collect()}
    assert len(got) == len(more)
    assert all(abs(got[i].lof - alone[i]) < 1e-12 for i in range(30))
    assert got[200].lof is None and got[200].is_inlier
    assert abs(got[100].lof - 1.0) < 1e-9 and abs(got[101].lof - 1.0) < 1e-9
    assert all(got[i].lof is not None for i in (300, 301, 302))


def test_zero_vector_does_not_stop_single_linkage(spark):
    x = np.array([[1.0, 0.0], [0.9, 0.1], [0.0, 0.0], [-1.0, 0.0], [0.0, 0.0]])
    got = {r.id: r.cluster for r in single_linkage(frame(spark, x), "id", "v", 0.5).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 4: 2, 3: 3}
    got = {r.id: r.cluster for r in single_linkage(frame(spark, x), "id", "v", 1.5).collect()}
    assert set(got.values()) == {0}


def test_components_of_a_long_chain(spark):
    n = 3000
    v = spark.range(n + 2)
    e = spark.range(n - 1).selectExpr("id as src", "id + 1 as dst")
    got = {r.id: r.component for r in connected_components(v, e).collect()}
    assert len(got) == n + 2 and all(got[i] == 0 for i in range(n)) and got[n] == n and got[n + 1] == n + 1


def test_grid_prunes_on_spread_data(spark):
    """Verified block pairs grow with the data, not with its square, at fixed density."""
    from sift.operators.neighbors import Grid, dedupe_vectors
    def blocks(n):
        rng = np.random.default_rng(1)
        x = rng.uniform(0, np.sqrt(n), size=(n, 2))
        reps, _ = dedupe_vectors(frame(spark, x), "id", "v")
        grid = Grid(reps)
        pairs = grid.pairs_within(1.0 + 0 * F.col("x"), F.lit(1.0))
        return pairs.count()
    from pyspark.sql import functions as F
    assert blocks(4000) < 6 * blocks(1000)


def test_group_quantile_matches_numpy(spark):
    from sift.operators.stats import group_quantile
    rng = np.random.default_rng(2)
    rows = [(g, float(v), int(w)) for g in ("a", "b") for v, w in zip(rng.integers(0, 9, 50), rng.integers(1, 4, 50))] + [("c", 5.0, 1), ("c", None, 3)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    for p in (0.0, 0.15, 0.5, 1.0):
        got = {r.g: r.q for r in group_quantile(df, "g", "v", p, "w").collect()}
        for g in ("a", "b", "c"):
            want = np.percentile([v for h, v, w in rows if h == g and v is not None for _ in range(w)], 100 * p)
            assert abs(got[g] - want) < 1e-12


def test_a_far_point_asks_few_cells(spark):
    """2,000 close points and one at distance 1,000: coarser cells answer a wide radius."""
    from pyspark.sql import functions as F

    from sift.operators.neighbors import REACH, Grid, dedupe_vectors, knn
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(2000, 4)), np.full((1, 4), 500.0)])
    reps, _ = dedupe_vectors(frame(spark, x), "id", "v")
    grid = Grid(reps)
    radius = F.when(F.col("id") == 2000, 1100.0).otherwise(0.5)
    asked = grid.asked(radius, F.lit(0.3)).groupBy("id").count().collect()
    assert max(r["count"] for r in asked) <= (2 * REACH + 1) ** 2 and len(asked) == 2001
    got = {}
    for r in knn(frame(spark, x), "id", "v", 3).collect():
        got.setdefault(r.q, []).append(round(r.dist, 9))
    for i in (0, 7, 2000):
        d = np.sort(np.sqrt(((x - x[i]) ** 2).sum(1)))[1:4]
        assert np.allclose(sorted(got[i]), d)


def test_approximate_neighbours(spark):
    from pyspark.sql import functions as F

    from sift.operators.approximate import approximate_knn, recall
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24)) * 2
    x = np.vstack([centres[i % 40] + rng.normal(size=24) * 0.6 for i in range(1500)] + [np.zeros((1, 24))] * 60)
    df = frame(spark, x)
    found = approximate_knn(df, "id", "v", 10, bucket=100).cache()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    rows = found.collect()
    assert all(abs(r.dist - d[r.q, r.s]) < 1e-9 and r.q != r.s for r in rows)
    assert len({(r.q, r.s) for r in rows}) == len(rows)
    np.fill_diagonal(d, np.inf)
    far = np.sort(d, axis=1)[:, 9]
    asked = [i for i in range(len(x)) if i % 20 == 0]
    hits = {i: 0 for i in asked}
    for r in rows:
        if r.q in hits:
            hits[r.q] += r.dist <= far[r.q] + 1e-9
    want = sum(min(10, h) for h in hits.values()) / (10 * len(asked))
    got = recall(found, df, "id", "v", 10, F.col("id") % 20 == 0).first()
    assert got.n_queries == len(asked) and abs(got.recall - want) < 1e-9 and got.recall >= 0.9
    assert approximate_knn(df.limit(0), "id", "v", 3).count() == 0
    exact = approximate_knn(df, "id", "v", 4, bucket=10_000)  # one bucket: nothing is missing
    assert recall(exact, df, "id", "v", 4, F.col("id") % 20 == 0).first().recall == 1.0


def test_no_pair_of_blocks_is_shuffled(spark):
    """One crowded cell of several blocks and parts: every row is shuffled few times, and nothing is missing."""
    from pyspark.sql import functions as F

    from sift.operators import neighbors as N
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(500, 8)) / 4, rng.normal(size=(40, 8)) / 4 + 9])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    reps, _ = N.dedupe_vectors(frame(spark, x), "id", "v")
    wide, parts, N.WIDE, N.PARTS = N.WIDE, N.PARTS, 40, 3
    try:
        grid = N.Grid(reps)
        pairs = grid.pairs_within(F.lit(0.9), F.lit(0.9))
        assert "RoundRobin" not in pairs._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.q, r.s) for r in pairs.collect())
        assert got == sorted(zip(*(a.tolist() for a in np.nonzero(d <= 0.9))))
        counts = grid.pairs_within(F.lit(0.9), F.lit(0.9), counts=True).groupBy("q").agg(F.sum("nb").alias("n")).collect()
        assert {r.q: r.n for r in counts} == {i: n for i, n in enumerate((d <= 0.9).sum(1).tolist()) if n}
        edges = [(r.q, r.s) for r in grid.pairs_within(F.lit(0.9), F.lit(0.9), forest=True).collect()]
        assert len(edges) < len(got) / 2 and union_find(len(x), edges) == union_find(len(x), got)
        found = {}
        for r in N.knn(frame(spark, x), "id", "v", 5).orderBy("q", "rank").collect():
            found.setdefault(r.q, []).append(r.s)
        assert all(found[i] == np.argsort(d[i], kind="stable")[:5].tolist() for i in range(len(x)))
    finally:
        N.WIDE, N.PARTS = wide, parts


def test_a_forest_keeps_the_components():
    from sift.operators.neighbors import _forest
    rng = np.random.default_rng(6)
    for share in (0.0, 0.01, 0.03, 0.3, 1.0):
        a = rng.random((40, 50)) < share
        i, j = _forest(a)
        assert a[i, j].all() and len(i) <= 89
        edges = [[(x, 40 + y) for x, y in zip(*p)] for p in ((i.tolist(), j.tolist()), (n.tolist() for n in np.nonzero(a)))]
        assert union_find(90, edges[0]) == union_find(90, edges[1])
