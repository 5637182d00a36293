"""An append-only log of a table's changes, and tables that follow it.

A commit writes one version: the rows put in or changed, and the keys taken out. It is written aside and then renamed into the log, so a reader
sees it whole or not at all; versions rise by one, and a commit that is run again with its version changes nothing. The log is read
as a file stream whose checkpoint holds what was read: nobody compares two full versions of a table to learn what changed.

A following table is a folder of deltas, one per micro-batch, each with the last change per key that the batch saw, and the version it came from.
Work per batch depends on the changes in it, not on the rows followed so far. Where deltas disagree on a key the higher
version counts, so batches may be run again, in any order, and from a new checkpoint. :func:`fold` joins deltas to one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, stage
from .merge import one_per_key

VERSION, CHANGE = "_version", "_change"
_DELTA, _FOLDED = "delta-", "folded-"


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the sub-folders that carry this prefix, rising."""
    files, folder = _files(spark, path)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def versions(spark: SparkSession, log: str) -> list[int]:
    return _numbered(spark, log, "v=")


def commit(changes: DataFrame, log: str, key: Sequence[str], version: int | None = None) -> int:
    """Appends one version and returns it. ``changes`` has ``_change`` (insert, update or delete), the key and the other columns, which deletes leave NULL.

    Of several changes to one key in a commit the delete comes last. With ``version`` a commit that is already in the log is left as it is.
    One writer per log at a time, as for a table.
    """
    spark = changes.sparkSession
    have = versions(spark, log)
    version = (have[-1] + 1 if have else 1) if version is None else version
    if version in have:
        return version
    if have and version < have[-1]:
        raise ValueError(f"version {version} comes after {have[-1]} in this log")
    kinds = F.when(F.col(CHANGE) == "delete", 1).otherwise(0)
    once = one_per_key(changes.withColumn("_last", kinds), key, ["_last"], keep="last").drop("_last")
    aside = scratch_path(spark, "commit")
    # Rows carry their version, so that a reader needs no more than the files.
    once.withColumn(VERSION, F.lit(version).cast("bigint")).write.parquet(aside)
    files, folder = _files(spark, log)
    files.mkdirs(folder)
    target = spark._jvm.org.apache.hadoop.fs.Path(folder, f"v={version:09d}")
    if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), target):
        raise RuntimeError(f"version {version} of {log} was written by another")
    return version


def upserts(current: DataFrame, batch: DataFrame, key: Sequence[str], removed: DataFrame | None = None) -> DataFrame:
    """Changes that put ``batch`` into a table and take the keys of ``removed`` out: which are inserts is told by the table's keys among the batch's."""
    flag = "_known"
    known = current.select(*key).join(batch.select(*key).distinct(), list(key), "left_semi").withColumn(flag, F.lit(True))
    put = batch.join(known, list(key), "left").withColumn(CHANGE, F.when(F.col(flag), "update").otherwise("insert")).drop(flag)
    if removed is None:
        return put
    gone = removed.select(*key).distinct().join(current.select(*key), list(key), "left_semi")
    return put.unionByName(gone.withColumn(CHANGE, F.lit("delete")), allowMissingColumns=True)


def read_log(spark: SparkSession, log: str, schema: T.StructType, after: int = 0) -> DataFrame:
    """The changes of versions above ``after`` as a table."""
    wanted = [f"{log}/v={v:09d}" for v in versions(spark, log) if v > after]
    full = log_schema(schema)
    return spark.read.schema(full).parquet(*wanted) if wanted else spark.createDataFrame([], full)


def log_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CHANGE, T.StringType()), T.StructField(VERSION, T.LongType())])


def stream_log(spark: SparkSession, log: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """The log as a stream; every file of every version is read once per checkpoint."""
    reader = spark.readStream.schema(log_schema(schema)).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{log}/v=*")


def follow(
    spark: SparkSession, log: str, table: str, checkpoint: str, schema: T.StructType, key: Sequence[str],
    derive: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_batch: int = 1000,
) -> int:
    """Brings a following table up to date with what the log holds now; returns how many micro-batches that took.

    ``derive`` makes the rows of the table from rows of the log, such as vectors from texts; it keeps the key, ``_change`` and ``_version``
    and runs for new and changed rows only.
    """
    if not versions(spark, log):
        return 0
    done = []

    def apply(batch: DataFrame, batch_id: int) -> None:
        last = one_per_key(batch, key, [VERSION], keep="last")
        kept = last.where(F.col(CHANGE) != "delete")
        gone = last.where(F.col(CHANGE) == "delete").select(*key, CHANGE, VERSION)
        out = derive(kept).unionByName(gone, allowMissingColumns=True)
        out.write.mode("overwrite").parquet(f"{table}/{_DELTA}{batch_id}")
        done.append(batch_id)

    source = stream_log(spark, log, schema, files_per_batch)
    query = source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(apply).start()
    query.awaitTermination()
    return len(done)


def _latest(spark: SparkSession, table: str, key: Sequence[str]) -> tuple[DataFrame | None, int]:
    """The last change per key, deletes included, and the newest delta it holds."""
    folded, deltas = _numbered(spark, table, _FOLDED), _numbered(spark, table, _DELTA)
    paths = [f"{table}/{_FOLDED}{folded[-1]}"] if folded else []
    paths += [f"{table}/{_DELTA}{d}" for d in deltas]
    if not paths:
        return None, -1
    # Each path is a table of its own: columns may have been added in between.
    rows = spark.read.option("mergeSchema", True).parquet(*paths)
    return one_per_key(rows, key, [VERSION], keep="last"), max([*deltas, *folded[-1:]])


def read_following(spark: SparkSession, table: str, key: Sequence[str]) -> DataFrame | None:
    """The rows of a following table as of the last change it has seen; None before the first."""
    rows, _ = _latest(spark, table, key)
    return None if rows is None else rows.where(F.col(CHANGE) != "delete").drop(CHANGE, VERSION)


def fold(spark: SparkSession, table: str, key: Sequence[str]) -> None:
    """Joins all deltas to one table, deletes kept, so that a late change of a lower version still loses. Readers see the same rows throughout.

    The folded table is renamed into place before what it holds is removed; a fold that stops in between leaves rows twice, which changes nothing.
    """
    rows, newest = _latest(spark, table, key)
    if rows is None:
        return
    folded, deltas = _numbered(spark, table, _FOLDED), _numbered(spark, table, _DELTA)
    if not deltas:
        return
    number = folded[-1] + 1 if folded else 0
    aside = scratch_path(spark, "fold")
    rows.write.parquet(aside)
    files, folder = _files(spark, table)
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not files.rename(path(aside), path(folder, f"{_FOLDED}{number}")):
        raise RuntimeError(f"{table} is being folded by another")
    for name in [*(f"{_DELTA}{d}" for d in deltas), *(f"{_FOLDED}{f}" for f in folded)]:
        files.delete(path(folder, name), True)


def changes_between(before: DataFrame, after: DataFrame, key: str, watched: Sequence[str]) -> DataFrame:
    """Changes of a source that only hands out full versions, in the form of :func:`commit`."""
    from .snapshot import diff

    found = stage(diff(before, after, key, watched), "changes").withColumnRenamed("change", CHANGE)
    put = after.join(found.where(F.col(CHANGE) != "delete"), key)
    return put.unionByName(found.where(F.col(CHANGE) == "delete"), allowMissingColumns=True)
