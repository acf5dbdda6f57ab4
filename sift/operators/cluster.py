"""Clustering jobs: single linkage, density clusters (fixed radius), k-means, silhouette."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.operators.graph import connected_components
from sift.operators.neighbors import Grid, dedupe_vectors
from sift.session import cut_lineage, importable


def single_linkage(points: DataFrame, id_col: str, vec_col: str, threshold: float = 0.55) -> DataFrame:
    """M5d + J9: single-linkage clusters cut at a cosine distance ``threshold``.

    Exactly the connected components of the graph with an edge for every pair
    with cosine distance below the threshold (``|u - v|^2 / 2`` on unit vectors).
    A block pair hands on a spanning forest of its edges only.  A zero vector is
    at distance 1 from every other.  Label = smallest id of the component.
    """
    reps, mapping = dedupe_vectors(points, id_col, vec_col, normalize=True)
    grid = Grid(reps)
    r = math.sqrt(2.0 * threshold)
    zero = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)) == 0
    zeros = reps.filter(zero).select("id")
    # strictly below the threshold: a radius that ends just under it
    near = grid.pairs_within(F.lit(r), F.lit(r), forest=True).filter(F.col("dist") * F.col("dist") / 2 < threshold)
    near = near.join(zeros.withColumnRenamed("id", "q"), "q", "left_anti").join(zeros.withColumnRenamed("id", "s"), "s", "left_anti")
    edges = near.select(F.col("q").alias("src"), F.col("s").alias("dst"))
    hub = zeros.first() if threshold > 1.0 else None  # copies are one row
    if hub is not None:  # a zero vector then links with all others
        edges = edges.unionByName(reps.select(F.col("id").alias("src"), F.lit(hub["id"]).alias("dst")))
    comp = connected_components(reps.select("id"), edges)
    return mapping.join(comp, "id").select(F.col("orig_id").alias(id_col), F.col("component").alias("cluster"))


def density_clusters(points: DataFrame, id_col: str, vec_col: str, eps: float, min_samples: int,
                     min_cluster_size: int, normalize: bool = False) -> DataFrame:
    """Density clusters at a fixed radius (DBSCAN*).

    A point is core when at least ``min_samples`` points (itself and its
    copies included) lie within ``eps``; core points within ``eps`` of each
    other are linked (mutual-reachability distance <= eps); components are
    clusters; non-core points and clusters smaller than ``min_cluster_size``
    points are noise (-1).  Label = smallest id of the cluster.
    """
    reps, mapping = dedupe_vectors(points, id_col, vec_col, normalize)
    grid = Grid(reps)
    cnt = grid.pairs_within(F.lit(float(eps)), F.lit(float(eps)), counts=True).groupBy("q").agg(F.sum("nb").alias("nb"))
    core = cut_lineage(reps.join(cnt.withColumnRenamed("q", "id"), "id", "left")
                       .withColumn("n_within", F.col("mult") + F.coalesce("nb", F.lit(0)))
                       .filter(F.col("n_within") >= min_samples).select("g", "id", "v", "mult"))
    # links among core points only, so a block pair's forest is one of core points
    links = Grid(core).pairs_within(F.lit(float(eps)), F.lit(float(eps)), forest=True)
    comp = connected_components(core.select("id"), links.select(F.col("q").alias("src"), F.col("s").alias("dst"))).join(core.select("id", "mult"), "id")
    sizes = comp.groupBy("component").agg(F.sum("mult").alias("size"))
    good = comp.join(sizes, "component").filter(F.col("size") >= min_cluster_size).select("id", "component")
    lab = mapping.join(good, "id", "left").select(F.col("orig_id").alias(id_col),
                                                 F.coalesce("component", F.lit(-1)).cast("long").alias("cluster"))
    return lab


def kmeans(points: DataFrame, id_col: str, vec_col: str, k: int, max_iter: int = 100, seed: int = 42,
           bisecting: bool = False) -> DataFrame:
    """M5a / M5e: Spark ML (bisecting) k-means; returns ``(id, cluster)``."""
    df = points.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    est = (BisectingKMeans(k=k, maxIter=max_iter, seed=seed) if bisecting
           else KMeans(k=k, maxIter=max_iter, seed=seed, initMode="k-means||"))
    model = est.fit(df)
    return model.transform(df).select(id_col, F.col("prediction").cast("int").alias("cluster"))


def _sums(x: np.ndarray, models: list[np.ndarray]) -> list[np.ndarray]:
    """Per model the number and the sum of the rows nearest to each centre: a matrix ``(n, sums..)``."""
    out = []
    for centres in models:
        near = _nearest_centre(x, centres)
        own = (near[None, :] == np.arange(len(centres))[:, None]).astype(np.float64)
        out.append(np.column_stack([own.sum(axis=1), own @ x]))
    return out


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2.0 * (x @ centres.T)).argmin(axis=1)


#: numbers (rows x dimensions) of a table of which every model gets a copy
FEW = 1 << 21


def _moved(x: np.ndarray, centres: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """Centres after the iterations of one model over all rows."""
    for _ in range(max_iter):
        new, moving = _step(_sums(x, [centres])[0], centres, tol)
        centres = new
        if not moving:
            break
    return centres


def _step(part: np.ndarray, centres: np.ndarray, tol: float) -> tuple[np.ndarray, bool]:
    """The means of the rows ``(n, sums..)`` nearest to each centre, and whether one has moved."""
    n = part[:, :1]
    new = np.where(n > 0, part[:, 1:] / np.maximum(n, 1.0), centres)
    return new, bool((((new - centres) ** 2).sum(axis=1) > tol * tol).any())


def _models_side_by_side(features: DataFrame, centres: dict[int, np.ndarray], max_iter: int, tol: float) -> dict[int, np.ndarray]:
    """Every model in a task of its own, with a copy of the few rows."""
    from pyspark.ml.functions import vector_to_array
    importable(features.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        k = table.column("k")[0].as_py()
        v = table.column("v").combine_chunks()
        moved = _moved(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1), centres[k], max_iter, tol)
        return pa.table([pa.array([k], pa.int32()), pa.array([moved.ravel()], pa.list_(pa.float64()))], names=["k", "centres"])
    copies = features.select(F.explode(F.array(*[F.lit(k) for k in centres])).alias("k"), vector_to_array("features").alias("v"))
    rows = copies.repartition(len(centres), "k").groupBy("k").applyInArrow(lambda t: run(t), "k int, centres array<double>").collect()
    return {r["k"]: np.array(r["centres"]).reshape(centres[r["k"]].shape) for r in rows}


def kmeans_of_sizes(features: DataFrame, ks: list[int], max_iter: int = 100, seed: int = 42, tol: float = 1e-4, parallel: int = 4) -> dict[int, np.ndarray]:
    """Centres of k-means for every k of ``ks`` over ``features(features vector)``: Spark ML's starts, and all models' iterations in one
    pass each over the rows; of a few rows every model has a copy and a task.  The driver holds the centres alone."""
    from concurrent.futures import ThreadPoolExecutor

    def start(k: int) -> np.ndarray:
        return np.array(KMeans(k=k, maxIter=0, seed=seed).fit(features).clusterCenters())
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        centres = dict(zip(ks, pool.map(start, ks)))
    if features.count() * centres[ks[0]].shape[1] <= FEW:
        return _models_side_by_side(features, centres, max_iter, tol)
    importable(features.sparkSession)

    def block(rows):
        part = [r[0].toArray() for r in rows]
        return [np.array(part)] if part else []
    blocks = features.select("features").rdd.mapPartitions(block).persist()
    # an iteration is a job: few partitions hand their sums to the driver at once
    depth = 1 if blocks.getNumPartitions() <= 64 else 2
    moving = list(ks)
    for _ in range(max_iter):
        if not moving:
            break
        models = [centres[k] for k in moving]
        total = blocks.map(lambda x, models=models: _sums(x, models)).treeReduce(lambda a, b: [p + q for p, q in zip(a, b)], depth=depth)
        still = []
        for k, part in zip(moving, total):
            centres[k], moves = _step(part, centres[k], tol)
            if moves:
                still.append(k)
        moving = still
    blocks.unpersist()
    return centres


def nearest_centres(features: DataFrame, models: list[np.ndarray], name: str = "predictions") -> DataFrame:
    """The rows with the number of the nearest centre of every model: ``name array<double>``."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql.types import ArrayType, DoubleType

    @F.arrow_udf(ArrayType(DoubleType()))
    def near(v: pa.Array) -> pa.Array:
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        at = np.stack([_nearest_centre(x, c) for c in models], axis=1).astype(np.float64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * len(models), pa.int32()), pa.array(at.ravel()))
    return features.withColumn(name, near(vector_to_array("features")))


def silhouette(points: DataFrame, vec_col: str, cluster_col: str, metric: str = "cosine") -> float:
    """Mean silhouette with Spark's linear-time evaluator (noise counts as a cluster)."""
    df = points.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"),
                       F.col(cluster_col).cast("double").alias("prediction"))
    ev = ClusteringEvaluator(distanceMeasure="cosine" if metric == "cosine" else "squaredEuclidean",
                             featuresCol="features", predictionCol="prediction")
    return float(ev.evaluate(df))


def silhouette_samples(points: DataFrame, id_col: str, vec_col: str, cluster_col: str) -> DataFrame:
    """Silhouette (squared Euclidean) of every point in linear form: ``(id, cluster, silhouette)``.

    The mean squared distance of x to the points of a cluster is
    ``|x|^2 - 2 x.m + q`` with m their mean and q the mean of their squared norms, so
    blocks of points meet blocks of clusters, and one row a point and block leaves the task.
    The only point of a cluster, and every point of a single cluster, has 0.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer
    from sift.operators.blocks import against, matrix
    from sift.operators.vectors import dot
    pts = points.select(F.col(id_col), F.col(cluster_col).alias("cluster"), F.col(vec_col).cast("array<double>").alias("v"))
    pts = pts.withColumn("sq", dot("v", "v"))
    cents = pts.groupBy("cluster").agg(
        vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("m"), F.avg("sq").alias("q"), F.count(F.lit(1)).alias("n"))
    kinds = {c: pts.schema[c].dataType.simpleString() for c in (id_col, "cluster")}

    def run(l, m):
        # the own cluster, and the nearest other one of this block
        far = l.field("sq").to_numpy()[:, None] - 2 * matrix(l, "v") @ matrix(m, "m").T + m.field("q").to_numpy()[None]
        own = l.field("cluster").to_numpy(zero_copy_only=False)[:, None] == m.field("cluster").to_numpy(zero_copy_only=False)[None]
        other = np.where(own, np.inf, far).min(axis=1)
        at, here = own.argmax(axis=1), own.any(axis=1)
        d = far[np.arange(len(l)), at]
        return pa.RecordBatch.from_arrays([
            l.field(id_col), l.field("cluster"), pa.array(d, mask=~here), pa.array(m.field("n").to_numpy()[at], pa.int64(), mask=~here),
            pa.array(other, mask=np.isinf(other))], names=[id_col, "cluster", "d", "n", "b"])
    parts = against(pts.select(id_col, "cluster", "v", "sq"), id_col, cents, "cluster", run,
                    f"{id_col} {kinds[id_col]}, cluster {kinds['cluster']}, d double, n bigint, b double")
    s = parts.groupBy(id_col, "cluster").agg(F.max(F.when(F.col("n").isNotNull(), F.struct("d", "n"))).alias("own"), F.min("b").alias("b"))
    a = F.col("own.d") * F.col("own.n") / (F.col("own.n") - 1)
    s = s.withColumn("a", F.when(F.col("own.n") > 1, a))
    return s.select(id_col, "cluster", F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0)
                    .otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


def cluster_stats(labels: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """A11 + A10 + L7: cluster count (noise counts as one), noise size, sizes."""
    sizes = labels.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col(cluster_col) == -1, F.col("size"))), F.lit(0)).cast("long").alias("n_outliers"),
        F.sum("size").cast("long").alias("n_points"),
        F.max("size").alias("max_size"), F.min("size").alias("min_size"),
        F.max(cluster_col).cast("long").alias("max_cluster"))
