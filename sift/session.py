"""Session helpers.

The library never invents storage locations on a cluster: lineage is cut
with ``DataFrame.checkpoint()`` into the directory that the cluster names in
``spark.checkpoint.dir``.  Only a local-mode session without that setting
(unit tests) gets a fresh scratch directory.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BATCH_BYTES = 32 << 20


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a driver started in
    another folder; on a cluster the package is shipped or installed and the path is not used)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` of rows, unless the session sets a bound itself:
    10,000 long texts would otherwise be one batch."""
    importable(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) >= 2**31 - 1:
        spark.conf.set(key, str(BATCH_BYTES))


def get_spark(master: str = "local[8]", app: str = "sift", shuffle_partitions: int = 8,
              extra: dict | None = None, checkpoint: str | None = None) -> SparkSession:
    """A session; ``checkpoint`` names the folder for checkpoints, which are removed when no longer used."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if checkpoint:
        builder = builder.config("spark.checkpoint.dir", checkpoint)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, configuring it from the session.

    Order: an already active SparkContext checkpoint dir, then the
    ``spark.checkpoint.dir`` setting.  Only a local-mode session with
    neither gets a private scratch directory (tests); a cluster session
    without a shared directory is an error rather than a silent local path.
    """
    importable(spark)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative jobs")
        conf_dir = tempfile.mkdtemp(prefix="sift-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str = "table"):
    """A table written to the checkpoint folder and read back, for loops.

    A checkpointed DataFrame keeps the size estimate of its plan, which every join multiplies: after some rounds
    planning itself takes minutes.  A stored table is estimated by its files.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Task count for compute-heavy stages: the larger of shuffle partitions and cores."""
    importable(spark)
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(shuffle, spark.sparkContext.defaultParallelism)


def spread(df, *cols):
    """Explicit repartition before a step whose output or CPU cost is much
    larger than its input (exploding joins, per-row vector math).

    AQE coalesces shuffles by input bytes, which would run such a step in one
    task when its input is small; an explicit partition count is kept.  With
    key columns the rows are hash partitioned (co-partitioning a join); without
    keys they are dealt round-robin — use that after an aggregation on the same
    key, where a hash repartition would be dropped as redundant.
    """
    return df.repartition(parallelism(df.sparkSession), *cols)


def ensure_parallel(df):
    """Give a small scan at least two partitions per core.

    A file with one row group is read by one task however it is split; when a
    scan yields fewer partitions than that, rows are spread round-robin over the session's parallelism
    first.  A large scan already has more splits and is returned unchanged: a shuffle of it
    would write the whole table to disk once more.
    """
    spark = df.sparkSession
    importable(spark)
    return df.repartition(parallelism(spark)) if df.rdd.getNumPartitions() < min(parallelism(spark), 2 * spark.sparkContext.defaultParallelism) else df
