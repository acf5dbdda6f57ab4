"""Parameter grids, grid search and the run table (replaces the document store).

The run table has one row per evaluated grid node:
``grid_id int, node int, mode string, embeddings string,
parameters map<string, map<string, string>>, silhouette double,
n_clusters long, n_outliers long, timestamp timestamp``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN_SCHEMA = ("grid_id int, node int, mode string, embeddings string, "
              "parameters map<string, map<string, string>>, silhouette double, "
              "n_clusters long, n_outliers long")


def dict_product(options: dict[str, list]) -> list[dict]:
    """Cartesian product inside one step; an empty step gives one empty node."""
    keys = sorted(options)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[options[k] for k in keys])]


def build_grid(steps: dict[str, dict[str, list]]) -> list[dict[str, dict]]:
    """M9: product within each step, then across steps (step order kept)."""
    names = list(steps)
    per_step = [dict_product(steps[s]) for s in names]
    return [dict(zip(names, combo)) for combo in itertools.product(*per_step)]


def grid_frame(spark: SparkSession, grid: list[dict], grid_id: int) -> DataFrame:
    rows = [(grid_id, i, {s: {k: str(v) for k, v in p.items()} for s, p in node.items()}) for i, node in enumerate(grid)]
    return spark.createDataFrame(rows, "grid_id int, node int, parameters map<string, map<string, string>>")


def run_grid(spark: SparkSession, points: DataFrame, id_col: str, vec_col: str, grid: list[dict],
             steps: dict[str, Callable], evaluate: Callable, grid_id: int, mode: str,
             embeddings: str = "given", parallel: int = 4) -> DataFrame:
    """Evaluate every node; nodes sharing a step prefix reuse one cached frame.

    ``steps[name](df, **params) -> df`` transform ``(id, vec)``; the last step
    must add ``cluster``.  ``evaluate(labelled_df) -> (silhouette, n_clusters, n_outliers)``.
    The loop is over grid nodes (configuration), never over data rows.
    """
    cache: dict = {}
    names = list(grid[0]) if grid else []
    # shared prefixes (e.g. the normalised frame) are built once, before the nodes run
    leaves = []
    for node_id, node in enumerate(grid):
        df = points
        key = ()
        for s in names[:-1]:
            key = key + ((s, tuple(sorted(node[s].items()))),)
            if key not in cache:
                cache[key] = steps[s](df, **node[s]).persist()
            df = cache[key]
        leaves.append((node_id, node, df))

    def run(item):
        node_id, node, df = item
        last = names[-1]
        sil, ncl, nout = evaluate(steps[last](df, **node[last]))
        return (grid_id, node_id, mode, embeddings,
                {s: {k: str(v) for k, v in node[s].items()} for s in names}, sil, ncl, nout)
    # nodes are independent: evaluate them as concurrent Spark jobs
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        out = sorted(pool.map(run, leaves), key=lambda r: r[1])
    for v in cache.values():
        v.unpersist()
    return spark.createDataFrame(out, RUN_SCHEMA).withColumn("timestamp", F.current_timestamp())


def next_grid_id(runs: DataFrame) -> DataFrame:
    """``max(grid_id) + 1``, 0 for an empty table; rows without the field skipped."""
    return runs.agg(F.coalesce(F.max("grid_id") + 1, F.lit(0)).cast("long").alias("next_grid_id"))


def best_config(runs: DataFrame, score_col: str = "silhouette", optimum: str = "max",
                order_col: str = "node") -> DataFrame:
    """A24 + L6: best node per (mode, grid_id); rows without a score skipped; on a
    tie the first inserted (smallest ``order_col``) wins."""
    s = F.col(score_col)
    o = [s.desc() if optimum == "max" else s.asc(), F.col(order_col).asc()]
    w = Window.partitionBy("mode", "grid_id").orderBy(*o)
    return (runs.filter(s.isNotNull()).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
                .select("mode", "grid_id", F.col(order_col).alias("best_node"), s.alias("best_score")))


def remove_grid(runs: DataFrame, grid_id: int) -> DataFrame:
    """K7: the run table without one grid id (written back with overwrite)."""
    return runs.filter(F.col("grid_id") != grid_id)
