"""Ward, average and complete linkage against plain sequential merging."""

import numpy as np
import pytest

from sift.operators.linkage import complete_linkage, cut_merges, linkage_merges


def fixture(n, seed=2):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(size=(n // 3, 3)) * 0.2 + c for c in ([3, 0, 0], [0, 3, 1], [0, 0, 4])] + [[[30.0, 1, 1]], [[-1.0, -8, 0]]])
    return np.vstack([x, x[:1], x[:1], x[:1]])  # copies


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(3)


def plain(x, method):
    """All merges (height, members) of the distinct points, the copies being one member of their number."""
    if method == "average":
        x = x / np.linalg.norm(x, axis=1)[:, None]
    first = {}
    for i, r in enumerate(map(tuple, x)):
        first.setdefault(r, []).append(i)
    parts = [m for m in first.values()]

    def far(a, b):
        if method == "ward":
            return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))
        if method == "average":
            return 1 - (x[a] @ x[b].T).mean()
        return np.sqrt(((x[a][:, None] - x[b][None]) ** 2).sum(-1)).max()
    out = []
    while len(parts) > 1:
        h, i, j = min((far(a, b), i, j) for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j)
        out.append((h, sorted(parts[i] + parts[j])))
        parts = [p for k, p in enumerate(parts) if k not in (i, j)] + [parts[i] + parts[j]]
    return out


def labels(merges, n, keep):
    label = list(range(n))
    for h, members in merges:
        if keep(h):
            for m in members:
                label[m] = min(members)
    return label


@pytest.mark.parametrize("method,n,finish", [("ward", 24, 12), ("average", 24, 14), ("ward", 60, 2000), ("average", 60, 2000)])
def test_merges_equal_the_sequential_ones(spark, method, n, finish):
    x = fixture(n)
    want = plain(x, method)
    merges, mapping = linkage_merges(frame(spark, x), "id", "v", method, finish)
    got = merges.collect()
    assert np.allclose(sorted(r.height for r in got), sorted(h for h, _ in want), rtol=1e-9, atol=1e-9)
    assert sorted(r.size for r in got) == sorted(len(m) for _, m in want)
    for k in (3, 5):
        cut = sorted((h for h, _ in want), reverse=True)[k - 2]
        copies = {tuple(r): i for i, r in reversed(list(enumerate(map(tuple, x))))}
        mine = labels(want, len(x), lambda h: h < cut)
        label = {r.orig_id: r.cluster for r in cut_merges(merges, mapping, n_clusters=k).collect()}
        assert label == {i: min(mine[i], copies[tuple(x[i])]) for i in range(len(x))} and len(set(label.values())) == k
        again = {r.orig_id: r.cluster for r in cut_merges(merges, mapping, threshold=float(cut) * (1 - 1e-12)).collect()}
        assert again == label


@pytest.mark.parametrize("threshold", [0.35, 2.5])
def test_complete_linkage(spark, threshold):
    x = fixture(30, 7)
    got = {r.id: r.cluster for r in complete_linkage(frame(spark, x), "id", "v", threshold, "euclidean").collect()}
    want = labels(plain(x, "complete"), len(x), lambda h: h < threshold)
    copies = {tuple(r): i for i, r in reversed(list(enumerate(map(tuple, x))))}
    assert got == {i: min(want[i], want[copies[tuple(x[i])]], copies[tuple(x[i])]) for i in range(len(x))}
    assert 2 < len(set(got.values())) < len(x) - 3


def test_complete_linkage_by_cosine_and_edges(spark):
    x = np.array([[1, 0], [2, 0.01], [1, 1], [-1, 0.2], [0, 0]], float)
    got = {r.id: r.cluster for r in complete_linkage(frame(spark, x), "id", "v", 0.1).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    schema = "id long, v array<double>"
    none = spark.createDataFrame([], schema)
    assert complete_linkage(none, "id", "v", 0.1).count() == 0
    merges, mapping = linkage_merges(none, "id", "v")
    assert merges.count() == 0 and mapping.count() == 0
    merges, mapping = linkage_merges(spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, None)], schema), "id", "v")
    assert merges.count() == 0 and sorted(r.cluster for r in cut_merges(merges, mapping, n_clusters=1).collect()) == [1, 1]
    with pytest.raises(ValueError):
        linkage_merges(none, "id", "v", "complete")


@pytest.mark.parametrize("method", ["ward", "average"])
def test_few_of_the_pairs_within_reach_leave_a_task(spark, method, monkeypatch):
    from sift.operators import linkage
    from sift.operators.neighbors import Grid, dedupe_vectors
    x = np.random.default_rng(5).normal(size=(300, 16))
    reps, _ = dedupe_vectors(frame(spark, x), "id", "v", normalize=method == "average")
    square = linkage.F.aggregate("v", linkage.F.lit(0.0), lambda s, v: s + v * v)
    clusters = reps.select("id", (linkage.F.col("id") % 5 + 1).alias("n"), "v").withColumn("sq", square)
    made, within = [], Grid.pairs_within
    monkeypatch.setattr(Grid, "pairs_within", lambda self, *a, **b: made.append(within(self, *a, **b)) or made[-1])
    got = {r.id: (r.other, r.h) for r in linkage._nearest_clusters(clusters, clusters.select("id"), method).collect()}
    assert made[-1].count() < 3 * len(x)
    rows = sorted(clusters.collect())
    v, n = np.array([r.v for r in rows]), np.array([r.n for r in rows], float)
    far = 1 - v @ v.T if method == "average" else np.sqrt(2 * n * n[:, None] / (n + n[:, None]) * ((v[:, None] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    assert [got[r.id][0] for r in rows] == [rows[j].id for j in far.argmin(1)]
    assert np.allclose([got[r.id][1] for r in rows], far.min(1))


@pytest.mark.parametrize("dim, finish", [(2, 70), (3, 90)])
def test_complete_linkage_by_rounds_hands_on_few_pairs(spark, dim, finish, monkeypatch):
    from sift.operators.neighbors import Grid
    x = np.random.default_rng(3).normal(size=(110, dim))
    made, within = [], Grid.pairs_within
    monkeypatch.setattr(Grid, "pairs_within", lambda self, *a, **b: made.append(within(self, *a, **b)) or made[-1])
    got = {r.id: r.cluster for r in complete_linkage(frame(spark, x), "id", "v", 4.0, "euclidean", finish).collect()}
    want = labels(plain(x, "complete"), len(x), lambda h: h < 4.0)
    assert got == {i: want[i] for i in range(len(x))} and 1 < len(set(got.values())) < 30
    # nearly all of the 12,000 pairs lie within the threshold
    assert max(m.count() for m in made) < 12 * len(x)


def test_corners_hold_the_farthest_member():
    from sift.operators.linkage import _corners
    rng = np.random.default_rng(1)
    for n, scale in ((4, 1.0), (60, 1e-6), (2000, 1e3)):
        x, y = rng.normal(size=(n, 2)) * scale, rng.normal(size=(50, 2)) * scale * 3
        few = _corners(x)
        far = lambda m: ((m[:, None] - y[None]) ** 2).sum(2).max(0)
        assert (far(few) == far(x)).all() and len(few) <= 40
    line = np.stack([np.arange(9.0), np.arange(9.0)], 1)
    assert {(0.0, 0.0), (8.0, 8.0)} <= {tuple(p) for p in _corners(line)}


def table_merges(x, method):
    """All merges ``(height, members)`` of distinct points, the nearest two of a table of distances at a time."""
    d = 1 - x @ x.T if method == "average" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    parts, n, out = [[i] for i in range(len(x))], np.ones(len(x)), []
    for _ in range(len(x) - 1):
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        h = d[i, j]
        parts[i] = sorted(parts[i] + parts[j])
        out.append((h, parts[i]))
        if method == "ward":
            new = np.sqrt(((n[i] + n) * d[i] ** 2 + (n[j] + n) * d[j] ** 2 - n * h * h).clip(0) / (n[i] + n[j] + n))
        else:
            new = np.maximum(d[i], d[j]) if method == "complete" else (n[i] * d[i] + n[j] * d[j]) / (n[i] + n[j])
        n[i] += n[j]
        new[i] = new[j] = np.inf
        d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
    return out


@pytest.mark.parametrize("method, threshold", [("ward", None), ("ward", 0.8), ("average", None), ("average", 0.02)])
def test_tiles_merge_what_no_other_cluster_is_nearer_to(spark, method, threshold, monkeypatch):
    from sift.operators import linkage
    rng = np.random.default_rng(11)
    x = rng.normal(size=(260, 2)) + 3 * rng.integers(0, 4, size=(260, 1))
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if method == "average" else x
    monkeypatch.setattr(linkage, "TILE", 40)
    turns, tiled = [], linkage._tiled
    monkeypatch.setattr(linkage, "_tiled", lambda clusters, rows, turn: turns.append(rows) or tiled(clusters, rows, turn))
    merges, _ = linkage_merges(frame(spark, x), "id", "v", method, 120, threshold)
    want = [(h, m) for h, m in table_merges(x, method) if threshold is None or h < threshold]
    got = merges.collect()
    assert np.allclose(sorted(r.height for r in got), sorted(h for h, _ in want), rtol=1e-9, atol=1e-9) and len(turns) > 0
    assert sorted(r.size for r in got) == sorted(len(m) for _, m in want)


@pytest.mark.parametrize("threshold", [0.4, 2.0])
def test_tiles_of_complete_linkage(spark, threshold, monkeypatch):
    from sift.operators import linkage
    x = np.random.default_rng(12).normal(size=(240, 2))
    monkeypatch.setattr(linkage, "TILE", 40)
    turns, tiled = [], linkage._tiled
    monkeypatch.setattr(linkage, "_tiled", lambda clusters, rows, turn: turns.append(rows) or tiled(clusters, rows, turn))
    got = {r.id: r.cluster for r in complete_linkage(frame(spark, x), "id", "v", threshold, "euclidean", 110).collect()}
    want = labels(table_merges(x, "complete"), len(x), lambda h: h < threshold)
    assert got == {i: want[i] for i in range(len(x))} and len(turns) > 0


def test_some_thousand_means_are_merged_in_one_task(spark, monkeypatch):
    from sift.operators import linkage

    def none(*args):
        raise AssertionError("a round of jobs")
    monkeypatch.setattr(linkage, "_nearest_clusters", none)
    x = np.random.default_rng(13).normal(size=(2300, 12))
    merges, mapping = linkage_merges(frame(spark, x), "id", "v", "average", threshold=0.4)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    rows = {r.orig_id: r.cluster for r in cut_merges(merges, mapping, threshold=0.4).collect()}
    groups: dict = {}
    for i, c in rows.items():
        groups.setdefault(c, []).append(i)
    means = np.array([unit[g].mean(axis=0) for g in groups.values()])
    far = 1 - means @ means.T
    np.fill_diagonal(far, np.inf)
    # no two clusters are within the threshold, and the members of every one are
    assert far.min() >= 0.4 and max(r.height for r in merges.collect()) < 0.4 and len(groups) < 600
