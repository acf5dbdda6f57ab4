"""Reduction of comment vectors, and the topic pipeline on reduced data (M3, M7, M8)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.session import cut_lineage


def pca_reduce(points: DataFrame, k: int, vec_col: str = "embedding") -> DataFrame:
    """M3: the vectors in their first ``min(k, d)`` principal components (centred), in place."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array
    first = points.select(F.size(vec_col).alias("d")).first()
    if first is None:
        return points
    x = points.withColumn("_x", array_to_vector(F.col(vec_col).cast("array<double>")))
    c = StandardScaler(withMean=True, withStd=False, inputCol="_x", outputCol="_c").fit(x).transform(x)
    p = PCA(k=min(int(k), first["d"]), inputCol="_c", outputCol="_p").fit(c).transform(c)
    return p.withColumn(vec_col, vector_to_array("_p")).drop("_x", "_c", "_p")


def normalise_step(df: DataFrame, on: bool = True) -> DataFrame:
    from sift.operators.neighbors import unit
    return df.withColumn("embedding", unit("embedding")) if str(on) == "True" else df


def reduce_step(df: DataFrame, k: int = 10) -> DataFrame:
    return cut_lineage(pca_reduce(df, int(k)))


def kmeans_step(df: DataFrame, k: int = 10, max_iter: int = 100, seed: int = 42) -> DataFrame:
    from sift.operators.cluster import kmeans
    return df.join(kmeans(df, "vec_id", "embedding", int(k), int(max_iter), int(seed)), "vec_id")


def density_step(df: DataFrame, eps: float = 0.5, min_samples: int = 5, min_cluster_size: int = 5) -> DataFrame:
    from sift.operators.cluster import density_clusters
    lab = density_clusters(df, "vec_id", "embedding", float(eps), int(min_samples), int(min_cluster_size))
    return df.join(lab, "vec_id")


def linkage_step(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    from sift.operators.cluster import single_linkage
    return df.join(single_linkage(df, "vec_id", "embedding", float(threshold)), "vec_id")


def hierarchy_step(df: DataFrame, min_cluster_size: int = 100, min_samples: int | None = None, alpha: float = 1.0) -> DataFrame:
    from sift.operators.hierarchy import density_hierarchy
    least = None if min_samples in (None, "None") else int(min_samples)
    return df.join(density_hierarchy(df, "vec_id", "embedding", int(min_cluster_size), least, float(alpha)), "vec_id")


def merge_step(df: DataFrame, linkage: str = "ward", threshold: float | None = None, n_clusters: int | None = None,
               affinity: str = "cosine") -> DataFrame:
    """Single or complete linkage cut at a distance; Ward (Euclidean) or average (cosine) at a distance or a number of clusters."""
    from sift.operators.cluster import single_linkage
    from sift.operators.linkage import complete_linkage, cut_merges, linkage_merges
    if linkage == "single":
        labels = single_linkage(df, "vec_id", "embedding", float(threshold))
    elif linkage == "complete":
        labels = complete_linkage(df, "vec_id", "embedding", float(threshold), affinity)
    else:
        merges, mapping = linkage_merges(df, "vec_id", "embedding", linkage, threshold=None if threshold is None or n_clusters is not None else float(threshold))
        labels = cut_merges(merges, mapping, None if n_clusters is None else int(n_clusters), None if threshold is None else float(threshold))
        labels = labels.withColumnRenamed("orig_id", "vec_id")
    return df.join(labels, "vec_id")


def outlier_step(df: DataFrame, k: int = 20, contamination: float = 0.15, group_col: str | None = None) -> DataFrame:
    """LOF on the reduced vectors, of all points or inside every group."""
    from sift.operators.neighbors import local_outlier_factor
    lof = local_outlier_factor(df, "vec_id", "embedding", int(k), float(contamination), group_col=group_col)
    return df.join(lof, "vec_id")


CLUSTER_STEPS: dict[str, Callable] = {"kmeans": kmeans_step, "density": density_step, "linkage": linkage_step,
                                      "hierarchy": hierarchy_step, "merge": merge_step}


def default_grid(mode: str, n_rows: int) -> dict[str, dict[str, list]]:
    """The parameter grid of a mode; ``min_samples`` of the density mode follows the number of rows."""
    steps: dict[str, dict[str, list]] = {"normalise": {"on": [False, True]}, "reduce": {"k": [2, 10, 50]}}
    if mode == "kmeans":
        steps["cluster"] = {"k": [5, 8, 10, 12, 15, 20], "max_iter": [100]}
    elif mode == "density":
        least = sorted({max(2, n_rows // d) for d in (1000, 500, 250, 100)})
        steps["cluster"] = {"eps": [0.05, 0.1, 0.2, 0.4], "min_samples": least, "min_cluster_size": [5, 10]}
    elif mode == "hierarchy":
        steps["cluster"] = {"min_cluster_size": [10, 30, 80, 100], "min_samples": [None, 1, max(1, int(math.log(max(n_rows, 2))))], "alpha": [0.1, 1.0]}
    elif mode == "merge":
        steps["cluster"] = {"linkage": ["complete", "average", "single"], "threshold": [0.1, 0.25, 0.5]}
    else:
        steps["cluster"] = {"threshold": [0.05, 0.1, 0.2]}
    return steps


def topic_pipeline(points: DataFrame, mode: str = "kmeans", reduce_k: int = 10, cluster: dict | None = None,
                   outliers: dict | None = None, normalise: bool = True) -> DataFrame:
    """M8: normalise -> reduce -> cluster -> outliers through :func:`run_steps`, on ``(vec_id, embedding, ...)``."""
    from sift.plans.steps import run_steps
    return run_steps(points, [("normalise", normalise_step, {"on": normalise}), ("reduce", reduce_step, {"k": reduce_k}),
                              ("cluster", CLUSTER_STEPS[mode], cluster or {}), ("outliers", outlier_step, outliers or {})])
