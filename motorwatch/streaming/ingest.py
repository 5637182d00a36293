"""Bounded, restartable ingestion of arriving files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import new_rows

BATCH = "ingest_batch"


def read_landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What has been ingested so far; an empty frame before the first batch."""
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType(), True)])
    try:
        return spark.read.schema(full).parquet(path)
    except Exception as missing:  # the path appears with the first batch
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], full)


def ingest_available(
    spark: SparkSession,
    files: DataFrame,
    key: Sequence[str],
    target: str,
    checkpoint: str,
    *,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    order: Sequence[str] = (),
    keep: str = "first",
) -> None:
    """Take in whatever a streaming file source holds now, then stop.

    Each micro-batch inserts the keys the target does not have and writes its own directory,
    ``ingest_batch=n``. A batch that is run again after a failure replaces that directory, so every
    row lands exactly once. How much one batch holds is set on the source
    (``maxFilesPerTrigger`` / ``maxBytesPerTrigger``).
    """
    schema = prepare(files).schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        landed = read_landed(session, target, schema).where(F.col(BATCH) != batch_id)
        fresh = new_rows(prepare(batch), landed, key, order, keep)
        fresh.write.mode("overwrite").parquet(f"{target}/{BATCH}={batch_id}")

    query = (
        files.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(merge)
        .start()
    )
    query.awaitTermination()


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB, on disk, not in the executors' memory."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def ingest_new_keys(
    spark: SparkSession, files: DataFrame, key: Sequence[str], target: str, checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> int:
    """Like :func:`ingest_available`, but what has landed is known from the stream's state: the target is never read.

    A micro-batch looks up its own keys, so its work does not grow with the rows landed. State holds the keys alone, on disk, dealt by
    key, and lies in the checkpoint: target and checkpoint belong together. Of equal keys the one that comes first enters; among equal
    keys of one micro-batch the engine chooses. Returns how many micro-batches ran.
    """
    done = []

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/{BATCH}={batch_id}")
        done.append(batch_id)

    fresh = prepare(files).dropDuplicates(list(key))
    with state_on_disk(spark):
        query = fresh.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(land).start()
        query.awaitTermination()
    return len(done)
