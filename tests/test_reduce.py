"""Reduction, the topic pipeline on reduced data and the stored run table."""

import numpy as np

from sift.operators import reduce as RD
from sift.operators import runs as RN
from tests.test_neighbors import brute_lof


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


def test_pca_equals_svd_up_to_sign(spark):
    x = np.random.default_rng(0).normal(size=(80, 6)) * np.array([5, 3, 2, 1, 0.5, 0.1])
    got = np.array([r.embedding for r in RD.pca_reduce(points(spark, x), 3).orderBy("vec_id").collect()])
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_pipeline_finds_outliers_on_reduced_vectors(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(40, 5)), rng.normal(size=(40, 5)) + 9])
    out = RD.topic_pipeline(points(spark, x), "kmeans", 2, {"k": 2}, {"k": 6, "contamination": 0.1}, normalise=False)
    got = {r.vec_id: r for r in out.collect()}
    z = np.array([got[i].embedding for i in range(80)])
    lof, inlier = brute_lof(z, 6, 0.1)
    assert all(abs(got[i].lof - lof[i]) < 1e-6 and got[i].is_inlier == bool(inlier[i]) for i in range(80))
    assert len({got[i].cluster for i in range(40)}) == 1 and {got[0].cluster} != {got[79].cluster}


def test_density_and_linkage_steps(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(30, 4)) * 0.1 + c for c in (1, 4, 9)] + [np.full((1, 4), 50.0)])
    r = {x.vec_id: x.cluster for x in RD.topic_pipeline(points(spark, x), "density", 2, {"eps": 0.5, "min_samples": 3}, {"k": 5}, False).collect()}
    assert len(set(r.values())) == 4 and r[90] == -1
    r = RD.topic_pipeline(points(spark, x + np.arange(4)), "linkage", 2, {"threshold": 0.2}, {"k": 5}).count()
    assert r == 91


def test_default_grids_follow_the_rows():
    a, b = RD.default_grid("density", 1000), RD.default_grid("density", 100_000)
    assert a["cluster"]["min_samples"] != b["cluster"]["min_samples"]
    for mode in ("kmeans", "density", "linkage", "hierarchy", "merge"):
        assert len(RN.build_grid(RD.default_grid(mode, 500))) > 10


def test_hierarchy_and_merge_steps(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(30, 4)) * 0.1 + c for c in ([1, 0, 0, 0], [0, 4, 0, 0], [0, 0, 9, 0])])
    for mode, cluster in (("hierarchy", {"min_cluster_size": 10, "min_samples": 4}), ("merge", {"linkage": "ward", "n_clusters": 3}),
                          ("merge", {"linkage": "complete", "threshold": 3.0, "affinity": "euclidean"})):
        step = RD.CLUSTER_STEPS[mode]
        r = {x.vec_id: x.cluster for x in step(points(spark, x), **cluster).collect()}
        assert [r[i] for i in range(90)] == [0] * 30 + [30] * 30 + [60] * 30


def test_best_clusterings_equal_sql_over_the_stored_rows(spark):
    from sift.plans.queries import grid_search_clusterings
    runs = grid_search_clusterings(spark, "/root/testdata/sf0.001")
    rows = runs.collect()
    assert len(rows) == 5 and {r.mode for r in rows} == {"hierarchy", "merge"}
    spark.createDataFrame(rows, runs.schema).createOrReplaceTempView("stored_runs")
    best = spark.sql("""SELECT grid_id, mode, node FROM (SELECT *, row_number() OVER (PARTITION BY mode, grid_id ORDER BY silhouette DESC, node) AS r
                        FROM stored_runs WHERE silhouette IS NOT NULL) WHERE r = 1""").collect()
    assert {tuple(b) for b in best} == {(r.grid_id, r.mode, r.node) for r in rows if r.is_best}


def test_best_run_of_a_stored_table(spark):
    from sift.plans.queries import grid_best_run, grid_search_runs
    sf = "/root/testdata/sf0.001"
    best = grid_best_run(spark, sf).collect()
    runs = grid_search_runs(spark, sf).collect()
    assert len(runs) == 12 and len(best) == 1
    top = min(runs, key=lambda r: (-r.silhouette, r.node))
    assert (best[0].best_node, best[0].best_score) == (top.node, top.silhouette)
