"""The hierarchy of densities against a brute-force one: spanning tree, condensed tree, clusters."""

import numpy as np
import pytest

from sift.operators import hierarchy
from sift.operators.hierarchy import condensed_tree, density_hierarchy, stable_clusters
from sift.operators.neighbors import dedupe_vectors
from sift.operators.spanning import spanning_tree


def unlike_densities(seed=5):
    """500 points: clusters of unlike density, two of which touch, scatter, far points and copies."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(120, 3)) * 0.05, rng.normal(size=(110, 3)) * 0.9 + [8, 0, 0],
             rng.normal(size=(70, 3)) * 0.12 + [0, 3, 0], rng.normal(size=(60, 3)) * 0.12 + [0.9, 3, 0],
             rng.uniform(-15, 15, size=(90, 3)), np.full((30, 3), 5.0), rng.normal(size=(17, 3)) * 0.02 + [5, 5, 5.2],
             [[400.0, 0, 0], [-9000.0, 3, 2], [401.0, 0, 0]]]
    return np.vstack(parts)


def weights(x, min_samples, alpha):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(min_samples, len(x)) - 1]
    return core, np.maximum(np.maximum(core[:, None], core[None]), d / alpha)


def brute(x, least, min_samples, alpha=1.0):
    """Labels, by cutting the complete graph of points at every weight from the heaviest down."""
    n = len(x)
    core, w = weights(x, min_samples, alpha)
    # a minimum spanning tree gives the same parts
    inside, best, frm, edges = {0}, w[0].copy(), np.zeros(n, int), []
    while len(inside) < n:
        best[list(inside)] = np.inf
        j = int(np.argmin(best))
        edges.append((best[j], int(frm[j]), j))
        inside.add(j)
        closer = w[j] < best
        best[closer], frm[closer] = w[j][closer], j
    lam = lambda t: 1.0 / max(t, hierarchy.LEAST)

    def parts(members, limit):
        left, out = set(members), []
        near = {m: [] for m in members}
        for t, a, b in edges:
            if t < limit and a in left and b in left:
                near[a].append(b)
                near[b].append(a)
        while left:
            todo, seen = [left.pop()], []
            while todo:
                p = todo.pop()
                seen.append(p)
                for q in near[p]:
                    if q in left:
                        left.remove(q)
                        todo.append(q)
            out.append(seen)
        return out

    def grow(members, birth):
        """(best stability, taken clusters) of the cluster that begins with these members."""
        now, stability = members, 0.0
        while True:
            inner = [t for t, a, b in edges if a in set(now) and b in set(now)]
            t = max(inner)
            large = [p for p in parts(now, t) if len(p) >= least]
            if len(large) == 1:
                stability += (len(now) - len(large[0])) * (lam(t) - birth)
                now = large[0]
                continue
            stability += len(now) * (lam(t) - birth)
            below = [grow(p, lam(t)) for p in large]
            best = sum(b for b, _ in below)
            if stability >= best:
                return stability, [members]
            return best, [c for _, cs in below for c in cs]

    labels = np.full(n, -1)
    if n < least:
        return labels
    root, now = list(range(n)), None
    taken, now = [], root
    while True:  # the root is never taken
        inner = [t for t, a, b in edges if a in set(now) and b in set(now)]
        t = max(inner)
        large = [p for p in parts(now, t) if len(p) >= least]
        if len(large) == 1:
            now = large[0]
            continue
        taken = [c for p in large for c in grow(p, lam(t))[1]]
        break
    for c in taken:
        labels[c] = min(c)
    return labels


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(4)


def test_spanning_tree_weight(spark):
    x = unlike_densities()
    for min_samples, alpha in ((5, 1.0), (12, 0.5)):
        reps, _ = dedupe_vectors(frame(spark, x), "id", "v")
        nodes, tree = spanning_tree(reps, min_samples, alpha)
        got = sorted(r.w for r in tree.collect())
        core, w = weights(x, min_samples, alpha)
        cores = {r.id: r.core for r in nodes.collect()}
        assert all(abs(core[i] - c) < 1e-9 for i, c in cores.items())
        keep = sorted(cores)
        w = w[np.ix_(keep, keep)]
        best, done, want = w[0].copy(), np.zeros(len(keep), bool), []
        done[0] = True
        for _ in range(len(keep) - 1):
            j = int(np.argmin(np.where(done, np.inf, best)))
            want.append(best[j])
            done[j] = True
            best = np.minimum(best, w[j])
        assert np.allclose(got, sorted(want), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("most,least,min_samples", [(200_000, 15, 5), (40, 15, 5), (7, 10, 10)])
def test_clusters_against_brute_force(spark, monkeypatch, most, least, min_samples):
    """Also with the tree condensed in many small pieces."""
    x = unlike_densities()
    plain = hierarchy.condensed_tree
    monkeypatch.setattr(hierarchy, "condensed_tree", lambda n, e, m: plain(n, e, m, most))
    got = {r.id: r.cluster for r in density_hierarchy(frame(spark, x), "id", "v", least, min_samples).collect()}
    want = brute(x, least, min_samples)
    assert [got[i] for i in range(len(x))] == want.tolist() and len(set(want.tolist())) >= 5


def test_equal_weights_are_one_event(spark):
    """A lattice: all edges weigh the same; large parts of it are summed by groups."""
    grid = [(float(a), float(b)) for a in range(8) for b in range(8)]
    x = np.array(grid + [(a + 40, b) for a, b in grid] + [(90.0, 0.0)] * 30)
    assert len(set(brute(x, 20, 1).tolist())) == 3
    reps, _ = dedupe_vectors(frame(spark, x), "id", "v")
    nodes, tree = spanning_tree(reps, 1)
    want = None
    for most in (1000, 10):
        clusters, members = condensed_tree(nodes, tree, 20, most)
        chosen = {r.cluster: r.chosen for r in stable_clusters(clusters).collect()}
        by = {}
        for r in members.collect():
            by.setdefault(chosen[r.cluster], set()).add(r.id)
        got = sorted(sorted(v) for k, v in by.items() if k is not None)
        assert sorted(map(len, got)) == [1, 64, 64] and (want is None or got == want)
        want = got
        sizes = sorted((round(r.stability, 6), r.size) for r in clusters.filter("parent is not null").collect())
        assert len(sizes) == 3 or len(sizes) == 4


def test_small_and_empty_inputs(spark):
    schema = "id long, v array<double>"
    assert density_hierarchy(spark.createDataFrame([], schema), "id", "v", 5).count() == 0
    few = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, None)], schema)
    assert sorted((r.id, r.cluster) for r in density_hierarchy(few, "id", "v", 5).collect()) == [(1, -1), (2, -1)]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], schema)
    assert {r.cluster for r in density_hierarchy(same, "id", "v", 5).collect()} == {-1}  # the root alone


def weights_of_tree(spark, x, min_samples):
    reps, _ = dedupe_vectors(frame(spark, x), "id", "v")
    nodes, tree = spanning_tree(reps, min_samples)
    rows = tree.collect()
    assert len({(r.a, r.b) for r in rows}) == len(rows) == nodes.count() - 1
    return sorted(r.w for r in rows)


def test_trees_of_pairs_of_blocks_hold_the_tree(spark, monkeypatch):
    """Blocks, one block and the rounds give trees of the same weights."""
    from sift.operators import linkage, spanning
    x = unlike_densities()[::4]
    whole = weights_of_tree(spark, x, 5)
    monkeypatch.setattr(spanning, "WHOLE", 20)
    monkeypatch.setattr(linkage, "TILE", 10)
    met, search = [], spanning._search
    monkeypatch.setattr(spanning, "_search", lambda *a: met.append(1) or search(*a))
    blocks = weights_of_tree(spark, x, 5)
    assert np.allclose(whole, blocks, rtol=1e-9, atol=1e-12) and not met
    monkeypatch.setattr(spanning, "MOST", 0)  # too many pairs of blocks: the rounds
    assert np.allclose(whole, weights_of_tree(spark, x, 5), rtol=1e-9, atol=1e-12) and met


def test_chosen_clusters_in_one_task_and_by_rounds(spark, monkeypatch):
    rows = [("r", None, 9.0), ("a", "r", 3.0), ("b", "r", 1.0), ("aa", "a", 2.0), ("ab", "a", 2.0), ("ba", "b", 0.5), ("bb", "b", 0.5), ("aaa", "aa", 1.0)]
    clusters = spark.createDataFrame(rows, "cluster string, parent string, stability double")
    got = []
    for most in (hierarchy.PIECE, 0):
        monkeypatch.setattr(hierarchy, "PIECE", most)
        got.append(({r.cluster: r.chosen for r in stable_clusters(clusters).collect()}, stable_clusters(clusters)._jdf.queryExecution().toString()))
    assert got[0][0] == got[1][0] == {"r": None, "a": None, "b": "b", "aa": "aa", "ab": "ab", "ba": "b", "bb": "b", "aaa": "aa"}
    assert "FlatMapGroupsInArrow" in got[0][1]
