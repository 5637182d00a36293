"""Targets bucketed by their key: a merge moves the batch to the buckets and leaves the target where it lies.

A plain table has to be shuffled by key for every batch that is too large to be broadcast. Here the target's files are already dealt and
sorted by key, so the batch alone is dealt to as many parts, and each part meets its bucket. NULL is a key value like any other: rows with a
NULL in their key, which no hash join on plain equality would find, are looked up by themselves, through a filter that reaches the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .merge import null_safe, one_per_key


def create_bucketed(spark: SparkSession, table: str, schema: T.StructType, key: Sequence[str], buckets: int) -> bool:
    """Creates the table empty; tells whether it was missing. ``buckets`` should make a bucket a few hundred megabytes at the size to come."""
    if spark.catalog.tableExists(table):
        return False
    spark.createDataFrame([], schema).write.format("parquet").bucketBy(buckets, *key).sortBy(*key).saveAsTable(table)
    return True


def bucket_spec(spark: SparkSession, table: str) -> tuple[int, list[str]]:
    """How many buckets the table has, and the columns they are made from."""
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    if "Num Buckets" not in told:
        raise ValueError(f"{table} is not bucketed")
    columns = [c.strip(" `") for c in told["Bucket Columns"].strip("[]").split(",")]
    return int(told["Num Buckets"]), columns


def _holds_null(key: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])


def new_in_buckets(
    spark: SparkSession, table: str, batch: DataFrame, order: Sequence[str | Column] = (), keep: str = "first"
) -> DataFrame:
    """Rows of ``batch`` to insert: one per key, and only keys the table does not have. The batch is shuffled once, the table not at all."""
    buckets, key = bucket_spec(spark, table)
    dealt = one_per_key(batch.repartition(buckets, *key), key, order, keep)
    known = spark.table(table).select(*[F.col(k).alias(f"_t_{k}") for k in key])
    equal = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_t_{k}") for k in key])
    full = dealt.where(~_holds_null(key)).join(known.hint("merge"), equal, "left_anti")
    blank = known.where(_holds_null([f"_t_{k}" for k in key]))
    return full.unionByName(dealt.where(_holds_null(key)).join(blank, null_safe([(k, f"_t_{k}") for k in key]), "left_anti"))


def merge_into_buckets(
    spark: SparkSession, table: str, batch: DataFrame, order: Sequence[str | Column] = (), keep: str = "first"
) -> None:
    """Appends the rows of ``batch`` whose key is new, one file per bucket. Running it twice changes nothing; one writer at a time."""
    buckets, key = bucket_spec(spark, table)
    target = spark.table(table)
    fresh = new_in_buckets(spark, table, batch, order, keep)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema.fields if f.name not in fresh.columns]
    fresh = fresh.select("*", *missing).select(*target.columns)
    fresh.write.mode("append").format("parquet").bucketBy(buckets, *key).sortBy(*key).saveAsTable(table)
