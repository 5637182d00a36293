from __future__ import annotations

import datetime as dt

from motorwatch.plans import reports
from motorwatch.streaming import scoring
from pyspark.sql import functions as F

TRACE = "trace_id string, request_time timestamp, request_preview string, response string, tags map<string,string>, assessments array<struct<name:string>>"


def at(hour: int, minute: int = 0) -> dt.datetime:
    return dt.datetime(2024, 5, 1, hour, minute)


def trace(name: str, when: dt.datetime, notes=None):
    return name, when, "q", '{"output":[{"type":"message","content":[{"text":"see 24V123"}]}]}', {"model_serving_endpoint_name": "agent"}, notes


def test_two_triggers_score_each_trace_once(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def run(*rows, **options):
        spark.createDataFrame(list(rows), TRACE).coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(spark.createDataFrame([], TRACE).schema).parquet(source)
        return scoring.score_available(spark, arriving, target, progress, endpoint="agent", **options)

    def scored():
        schema = spark.read.parquet(f"{target}/{scoring.BATCH}=0").schema
        return sorted(r["trace_id"] for r in scoring.read_scores(spark, target, schema).collect())

    assert run(trace("a", at(10)), trace("b", at(10), [("x",)]), trace("c", at(11))) == 1
    assert scored() == ["a", "c"]
    run(trace("a", at(10)), trace("d", at(12)))
    assert scored() == ["a", "c", "d"]
    assert spark.read.parquet(f"{target}/{scoring.BATCH}=0").first()["cite_id_present"] is True


def test_repeats_are_remembered_for_a_while(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for lot in ([trace("a", at(10)), trace("a", at(10))], [trace("a", at(10, 5)), trace("b", at(10, 30))]):
        spark.createDataFrame(lot, TRACE).coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(spark.createDataFrame([], TRACE).schema).parquet(source)
        scoring.score_available(spark, arriving, target, progress, repeats_within="1 hour")
    assert sorted(r["trace_id"] for r in spark.read.parquet(target).collect()) == ["a", "b"]


def test_late_assessments_are_waited_for(spark, tmp_path):
    traces, notes, out, progress = (str(tmp_path / n) for n in ("traces", "notes", "out", "progress"))
    spark.createDataFrame([], "trace_id string, assessed_at timestamp").write.parquet(notes)

    def run(new_traces, new_notes):
        spark.createDataFrame(new_traces, TRACE).coalesce(1).write.mode("append").parquet(traces)
        spark.createDataFrame(new_notes, "trace_id string, assessed_at timestamp").coalesce(1).write.mode("append").parquet(notes)
        left = spark.readStream.schema(spark.createDataFrame([], TRACE).schema).parquet(traces)
        right = spark.readStream.schema("trace_id string, assessed_at timestamp").parquet(notes)
        open_ = scoring.without_late_assessments(left, right)
        query = open_.writeStream.trigger(availableNow=True).option("checkpointLocation", progress).format("parquet").start(out)
        query.awaitTermination()
        return sorted(r["trace_id"] for r in spark.read.schema(open_.schema).parquet(out).collect())

    assert run([trace("a", at(10)), trace("b", at(10)), trace("c", at(11))], [("x", at(10))]) == []
    assert run([trace("d", at(11, 30))], [("a", at(10, 40))]) == [], "a was assessed, b and c still have time"
    assert run([trace("e", at(15))], [("b", at(12)), ("y", at(15))]) == ["b", "c", "d"], "b's assessment came too late"
    assert run([], []) == ["b", "c", "d"]


def test_levels_of_a_profile(spark, plan):
    df = spark.createDataFrame([("x", "p", 1), ("x", "q", 2), (None, "p", 4), ("y", None, 8)], "a string, b string, v int")
    found = reports.profile_levels(df, {"n": F.count("*"), "v": F.sum("v")}, [(), ("a",), ("a", "b")])
    assert plan(found).count("Exchange") == 1
    got = {(r["level"], r["a"], r["b"]): (r["n"], r["v"]) for r in found.collect()}
    assert got == {
        ("", None, None): (4, 15), ("a", "x", None): (2, 3), ("a", None, None): (1, 4), ("a", "y", None): (1, 8),
        ("a,b", "x", "p"): (1, 1), ("a,b", "x", "q"): (1, 2), ("a,b", None, "p"): (1, 4), ("a,b", "y", None): (1, 8),
    }
    assert reports.profile_levels(df, {"n": F.count("*")}, [()]).first()["n"] == 4
