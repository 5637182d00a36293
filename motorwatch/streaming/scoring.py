"""Scoring as a stream: each trace is scored once, in the run after it arrives or, where people assess, after they had their time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.monitoring import cheap_scores, unscored
from .ingest import state_on_disk

BATCH = "score_batch"


def score_available(
    spark: SparkSession, traces: DataFrame, target: str, checkpoint: str, *, endpoint: str | None = None,
    score: Callable[[DataFrame], DataFrame] = cheap_scores, repeats_within: str | None = None, time: str = "request_time",
) -> int:
    """Scores the traces that a streaming source holds now and that nobody has assessed; returns how many micro-batches ran.

    Each micro-batch writes its own directory, ``score_batch=n``, so one that is run again replaces it. A trace that arrives twice is scored once:
    the stream remembers trace ids, all of them or, with ``repeats_within``, those younger than that behind the newest trace, so
    that its state stays bounded.
    """
    done = []

    def write(batch: DataFrame, batch_id: int) -> None:
        score(unscored(batch, endpoint)).write.mode("overwrite").parquet(f"{target}/{BATCH}={batch_id}")
        done.append(batch_id)

    if repeats_within:
        once = traces.withWatermark(time, repeats_within).dropDuplicatesWithinWatermark(["trace_id"])
    else:
        once = traces.dropDuplicates(["trace_id"])
    with state_on_disk(spark):
        query = once.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()
        query.awaitTermination()
    return len(done)


def read_scores(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """All scores written so far."""
    return spark.read.schema(schema).parquet(f"{target}/{BATCH}=*")


def without_late_assessments(
    traces: DataFrame, assessments: DataFrame, wait: str = "1 hour", late: str = "10 minutes",
    time: str = "request_time", assessed: str = "assessed_at",
) -> DataFrame:
    """Streaming traces for which no assessment came within ``wait`` of their request; each is passed on once, when that time is over.

    Both sides are streams and may be ``late`` out of order. A trace waits in the join's state until the watermark has passed the end of its
    time, so state holds what is younger than ``wait`` and ``late`` together; assessments may come before or after their trace arrives.
    """
    given = assessments.select(F.col("trace_id").alias("_trace"), F.col(assessed).alias("_assessed")).withWatermark("_assessed", late)
    own = (F.col("trace_id") == F.col("_trace")) & (F.col("_assessed") >= F.col(time)) & (F.col("_assessed") <= F.col(time) + F.expr(f"INTERVAL {wait}"))
    joined = traces.withWatermark(time, late).join(given, own, "left_outer")
    return joined.where("_trace IS NULL").drop("_trace", "_assessed")
