from __future__ import annotations

import uuid

import pytest
from motorwatch.operators import bucketed
from motorwatch.streaming.ingest import BATCH, ingest_new_keys, read_landed
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("s", T.StringType()), T.StructField("v", T.IntegerType())])


@pytest.fixture
def table(spark):
    name = f"b_{uuid.uuid4().hex[:8]}"
    bucketed.create_bucketed(spark, name, SCHEMA, ["k", "s"], 8)
    yield name
    spark.sql(f"DROP TABLE {name}")


def rows(spark, table):
    return sorted(((r["k"], r["s"], r["v"]) for r in spark.table(table).collect()), key=repr)


def test_merge_keeps_known_keys_and_null_is_a_key(spark, table):
    assert bucketed.bucket_spec(spark, table) == (8, ["k", "s"])
    assert not bucketed.create_bucketed(spark, table, SCHEMA, ["k", "s"], 8)
    first = spark.createDataFrame([(1, "a", 5), (1, "a", 3), (None, "a", 1), (2, None, 2)], SCHEMA)
    bucketed.merge_into_buckets(spark, table, first, ["v"])
    want = sorted([(1, "a", 3), (None, "a", 1), (2, None, 2)], key=repr)
    assert rows(spark, table) == want
    again = spark.createDataFrame([(1, "a", 0), (None, "a", 9), (2, None, 9), (2, "b", 4), (None, None, 7), (None, None, 6)], SCHEMA)
    for _ in range(2):
        bucketed.merge_into_buckets(spark, table, again, ["v"])
    assert rows(spark, table) == sorted([*want, (2, "b", 4), (None, None, 6)], key=repr)
    bucketed.merge_into_buckets(spark, table, spark.createDataFrame([(8, "z")], "k int, s string"))
    assert (8, "z", None) in rows(spark, table)


def test_the_target_is_not_moved(spark, table, plan):
    bucketed.merge_into_buckets(spark, table, spark.range(1000).selectExpr("int(id) k", "'x' s", "1 v"))
    text = plan(bucketed.new_in_buckets(spark, table, spark.range(5000).selectExpr('int(id) k', 'string(id % 3) s', '2 v'), ["v"]))
    first = text[: text.index("BroadcastHashJoin")] if "BroadcastHashJoin" in text else text.split("Union")[0] + text
    lines = text.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
    join = max(i for i in range(scan) if "Join" in lines[i])
    depth = len(lines[join]) - len(lines[join].lstrip(" :+-*()0123456789"))
    between = [line for line in lines[join + 1 : scan] if ":" not in line[:depth]]
    assert "SortMergeJoin" in lines[join] and not any("Exchange" in line for line in between), first


def test_other_tables_are_refused(spark):
    spark.range(3).write.mode("overwrite").saveAsTable("plain_table")
    with pytest.raises(ValueError, match="not bucketed"):
        bucketed.bucket_spec(spark, "plain_table")


def test_keys_are_remembered_by_the_stream(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = T.StructType(SCHEMA.fields)

    def arrive(*values):
        spark.createDataFrame(list(values), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return ingest_new_keys(spark, files, ["k"], target, checkpoint)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    arrive((1, "a", 1), (2, "a", 1), (None, "a", 1))
    arrive((1, "b", 2), (3, "b", 2), (None, "b", 2))
    landed = read_landed(spark, target, schema)
    assert sorted(((r["k"], r["s"], r[BATCH]) for r in landed.collect()), key=repr) == sorted([(1, "a", 0), (2, "a", 0), (None, "a", 0), (3, "b", 1)], key=repr)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert arrive() == 0 or read_landed(spark, target, schema).count() == 4
