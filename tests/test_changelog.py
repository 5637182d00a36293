from __future__ import annotations

import pytest
from motorwatch.operators import changelog as C
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])
KEY = ["k"]


def rows(df) -> dict:
    return {r["k"]: r["v"] for r in df.collect()} if df is not None else {}


@pytest.fixture
def make(spark, tmp_path):
    log, table, checkpoint = (str(tmp_path / n) for n in ("log", "table", "checkpoint"))

    def changes(**by_kind):
        listed = [(k, v, kind) for kind, pairs in by_kind.items() for k, v in pairs]
        return spark.createDataFrame(listed, f"k int, v string, {C.CHANGE} string")

    return log, table, checkpoint, changes


def test_an_index_follows_changes_in_order_and_reads_each_once(spark, make):
    log, table, checkpoint, changes = make
    seen = []

    def derive(df):
        seen.extend(r["k"] for r in df.collect())
        return df.withColumn("upper", F.upper("v"))

    def run():
        return C.follow(spark, log, table, checkpoint, SCHEMA, KEY, derive)

    assert run() == 0 and C.read_following(spark, table, KEY) is None
    assert C.commit(changes(insert=[(1, "a"), (2, "b"), (3, "c")]), log, KEY) == 1
    assert run() == 1 and rows(C.read_following(spark, table, KEY)) == {1: "a", 2: "b", 3: "c"}
    assert C.commit(changes(update=[(2, "B")], delete=[(3, None)], insert=[(4, "d")]), log, KEY) == 2
    assert run() == 1 and rows(C.read_following(spark, table, KEY)) == {1: "a", 2: "B", 4: "d"}
    assert C.commit(changes(insert=[(3, "again")], delete=[(1, None)]), log, KEY) == 3
    assert run() == 1 and rows(C.read_following(spark, table, KEY)) == {2: "B", 3: "again", 4: "d"}
    assert run() == 0
    assert sorted(seen) == [1, 2, 2, 3, 3, 4], "each change is derived once, deletes are not"
    assert {r["upper"] for r in C.read_following(spark, table, KEY).collect()} == {"B", "AGAIN", "D"}


def test_versions_rise_and_a_commit_run_again_changes_nothing(spark, make):
    log, _, _, changes = make
    C.commit(changes(insert=[(1, "a")]), log, KEY, version=5)
    assert C.commit(changes(insert=[(1, "other")]), log, KEY, version=5) == 5
    assert C.commit(changes(update=[(1, "b")]), log, KEY) == 6
    with pytest.raises(ValueError, match="comes after"):
        C.commit(changes(insert=[(9, "x")]), log, KEY, version=2)
    assert C.versions(spark, log) == [5, 6]
    assert [(r["v"], r[C.VERSION]) for r in C.read_log(spark, log, SCHEMA).orderBy(C.VERSION).collect()] == [("a", 5), ("b", 6)]
    assert rows(C.read_log(spark, log, SCHEMA, after=5)) == {1: "b"}


def test_order_of_batches_and_new_checkpoints_do_not_matter(spark, make, tmp_path):
    log, table, checkpoint, changes = make
    for step in range(4):
        C.commit(changes(update=[(1, f"s{step}")], insert=[(10 + step, "x")], delete=[(10 + step - 1, None)] if step else []), log, KEY)
    assert C.follow(spark, log, table, checkpoint, SCHEMA, KEY, files_per_batch=1) > 3
    want = {1: "s3", 13: "x"}
    assert rows(C.read_following(spark, table, KEY)) == want
    C.follow(spark, log, table, str(tmp_path / "other"), SCHEMA, KEY)
    assert rows(C.read_following(spark, table, KEY)) == want


def test_folding_keeps_rows_and_deletes(spark, make):
    log, table, checkpoint, changes = make
    C.commit(changes(insert=[(1, "a"), (2, "b")]), log, KEY)
    C.follow(spark, log, table, checkpoint, SCHEMA, KEY)
    C.commit(changes(delete=[(1, None)]), log, KEY)
    C.follow(spark, log, table, checkpoint, SCHEMA, KEY)
    C.fold(spark, table, KEY)
    C.fold(spark, table, KEY)
    assert rows(C.read_following(spark, table, KEY)) == {2: "b"}
    C.commit(changes(insert=[(3, "c")]), log, KEY)
    C.follow(spark, log, table, checkpoint, SCHEMA, KEY)
    C.fold(spark, table, KEY)
    assert rows(C.read_following(spark, table, KEY)) == {2: "b", 3: "c"}
    assert C._numbered(spark, table, "delta-") == [] and len(C._numbered(spark, table, "folded-")) == 1


def test_changes_of_full_versions_and_of_upserts(spark, make):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], SCHEMA)
    after = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], SCHEMA)
    found = {(r["k"], r["v"], r[C.CHANGE]) for r in C.changes_between(before, after, "k", ["v"]).collect()}
    assert found == {(2, "B", "update"), (4, "d", "insert"), (3, None, "delete")}
    batch, removed = spark.createDataFrame([(2, "B"), (4, "d")], SCHEMA), spark.createDataFrame([(3, ""), (9, "")], SCHEMA)
    assert {(r["k"], r["v"], r[C.CHANGE]) for r in C.upserts(before, batch, KEY, removed).collect()} == found
