"""Session settings and shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}
_SCRATCH_ROOTS: set[str] = set()


def build_session(app_name: str = "motorwatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and Arrow batches kept small enough for long texts.

    Shuffle width is left to the cluster's own setting unless passed in ``conf``; adaptive
    execution coalesces small partitions and splits skewed ones at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        # Small files are split for all cores as well, as far as their row groups allow.
        "spark.sql.files.openCostInBytes": "1m",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one process (a laptop, a test) is a local folder made
    and set instead; on a cluster each executor would write to its own disk, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="motorwatch-")
        spark.sparkContext.setCheckpointDir(_LOCAL_FALLBACK[app])
    return _LOCAL_FALLBACK[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, never reused or overwritten.

    All of an application's scratch lies in one folder of its own, which goes when it ends.
    """
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/motorwatch/{app}"
    if root not in _SCRATCH_ROOTS:
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _SCRATCH_ROOTS.add(root)
    return f"{root}/{label}-{uuid.uuid4().hex[:12]}"


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each write in here go when it has ended, not when the driver happens to collect its garbage.

    For writes only: a frame that is run again would have to make its files again.
    """
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df, label: str, compression: str | None = None):
    """Write ``df`` once to shared storage and read it back.

    Used where one result feeds several consumers: the plan is cut at a durable file, so a
    lost executor re-reads it rather than recomputing what came before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)

