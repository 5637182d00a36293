"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from motorwatch.functions import privacy, scoring
from motorwatch.operators import merge, sessions, snapshot, vectors, worklist
from motorwatch.operators.chunking import chunks
from motorwatch.plans import reports
from motorwatch.querybook import registered
from motorwatch.session import shared_dir
from motorwatch.sources.taxonomy import resolve_make

D = "/root/testdata/sf0.001"


@pytest.fixture
def read(spark):
    return lambda name: spark.read.parquet(f"{D}/{name}.parquet")


#: Their results are reads of tables that they build when called, which takes a while; ``test_queries`` runs them.
BUILDERS = {"feeds_ingested_twice", "warehouse_built", "table_contract", "column_comments", "drain_backlog", "replaced_table"}


def test_no_query_runs_a_cross_join_or_row_by_row_python(spark, plan):
    for name, run in registered().items():
        if name in BUILDERS:
            continue
        text = plan(run(spark, D))
        for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "PythonUDTF"):
            assert banned not in text, (name, banned)


def test_keep_one_and_last_n_limit_groups_before_the_shuffle(read, plan):
    for df in (
        merge.one_per_key(read("lineitem"), ["l_orderkey"], ["l_linenumber"]),
        sessions.last_turns(read("conversations"), 3, "conv_id", "turn"),
    ):
        text = plan(df)
        below = text[text.index("Exchange") :]
        assert "WindowGroupLimit" in below and "Partial" in below


def test_anti_joins_are_anti_joins(read, plan):
    assert "LeftAnti" in plan(worklist.pending(read("documents"), read("labels"), "doc_id"))
    merged = plan(merge.new_rows(read("orders"), read("orders"), ["o_orderkey"], ["o_custkey"]))
    assert "LeftAnti" in merged and "LeftSemi" in merged  # the target is reduced to the batch's keys


def test_snapshots_meet_in_a_hash_aggregation(read, plan):
    text = plan(snapshot.diff(read("orders"), read("orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"]))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_vector_search_collects_no_queries(read, plan):
    queries = read("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    text = plan(vectors.top_k(read("embeddings"), queries, id_col="vec_id"))
    assert "Join" in text and "Union" not in text and "LocalTableScan" not in text


def test_year_filter_and_columns_reach_the_scan(read, plan):
    orders = read("orders").withColumn("event_date", F.col("o_orderdate"))
    text = plan(orders.where(reports.in_year(F.lit(1999))).select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    schema = text[text.index("ReadSchema") :]
    assert "o_orderkey" in schema and "o_comment" not in schema and "o_totalprice" not in schema


def test_taxonomy_is_broadcast_and_facts_shrink_before_joining(spark, read, plan):
    assert "BroadcastHashJoin" in plan(resolve_make(read("part"), "p_name"))
    facts = spark.range(1000).select((F.col("id") % 7).alias("k"))
    dim = spark.range(7).select(F.col("id").alias("k"), F.lit("x").alias("label"))
    text = plan(reports.top_by_count(facts, dim, "k", "label", "n"))
    join = next(i for i, line in enumerate(text.splitlines()) if "Join" in line)
    assert any("HashAggregate(keys=[k" in line for line in text.splitlines()[join:])
    assert "TakeOrderedAndProject" in text


def test_text_expressions_stay_in_generated_code(read, plan):
    df = read("documents").select(
        privacy.mask_personal("text"), scoring.cite_id_present("text"), scoring.mentions_any("text")
    )
    text = plan(df)
    assert "Python" not in text and "*(1) Project" in text


def test_chunks_never_leave_the_jvm(read, plan):
    text = plan(read("documents").select(chunks("text")))
    assert "Python" not in text and "Arrow" not in text


def test_partition_filter_prunes(spark, plan):
    text = plan(registered()["partition_pruned_read"](spark, D))
    assert "PartitionFilters: [isnotnull(order_year" in text


def test_partitioned_writes_are_rebalanced_on_the_partition_column(spark, plan):
    df = spark.range(100).withColumn("y", F.col("id") % 3).hint("rebalance", "y")
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(df)


def test_shared_folder_is_the_one_the_cluster_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)
