"""Session construction and the shared scratch location.

On a cluster the session is handed to us already configured; we only read
``spark.checkpoint.dir`` from it.  A local directory is created only when that
setting is absent (tests, laptop runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "monthpick",
    driver_memory: str = "16g",
) -> SparkSession:
    """Session for local runs (tests, bench).  Cluster jobs pass their own."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session.  A folder set by
    ``setCheckpointDir`` counts too.  A local master without either (tests,
    laptop runs) gets a local folder, created once per application and registered
    (``spark.checkpoint.dir`` itself cannot be changed at runtime).
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = sc.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="monthpick-ckpt-")
            sc.setCheckpointDir(_LOCAL_DIRS[app])
        return _LOCAL_DIRS[app]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-path of the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


# default stage boundary: a written Parquet table in the shared checkpoint folder
DEFAULT_STAGE = "table"


def materialize(df, mode: str | None = None, name: str = "stage", partition_by: str | None = None):
    """Stage boundary for a DataFrame used more than once.

    ``persist``    — MEMORY_AND_DISK; a lost executor's blocks are recomputed
                     from lineage.
    ``checkpoint`` — reliable checkpoint in the shared ``spark.checkpoint.dir``
                     (cuts lineage; use in long iterative jobs).
    ``table``      — Parquet written under the shared checkpoint folder and read
                     back: columnar, survives executor loss, cuts lineage.
                     ``partition_by`` gives partition pruning on read.
    ``none``       — leave the plan as is.
    """
    from pyspark import StorageLevel

    mode = mode or DEFAULT_STAGE
    if mode == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if mode == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if mode == "table":
        path = scratch_path(df.sparkSession, name)
        w = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            w = w.partitionBy(partition_by)
        w.parquet(path)
        out = df.sparkSession.read.parquet(path)
        if partition_by:  # keep the source type and column order of the partition column
            out = out.select(*[out[c].cast(t).alias(c) for c, t in df.dtypes])
        return out
    return df


def materialize_all(*dfs, mode: str | None = None, names=None):
    """Stage several independent DataFrames at once.

    Written tables / checkpoints are separate Spark jobs; submitting them from
    a small thread pool lets the scheduler run them side by side (one job's
    long tail leaves executors free for the other).  Returns them in order.
    """
    from concurrent.futures import ThreadPoolExecutor

    names = list(names or ["stage"] * len(dfs))
    if (mode or DEFAULT_STAGE) not in ("table", "checkpoint") or len(dfs) < 2:
        return [materialize(d, mode, n) for d, n in zip(dfs, names)]
    with ThreadPoolExecutor(max_workers=len(dfs)) as pool:
        futures = [pool.submit(materialize, d, mode, n) for d, n in zip(dfs, names)]
        return [f.result() for f in futures]
