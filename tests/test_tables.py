"""Feeds to typed tables to star schema and corpus in a catalog; streaming; monitoring; evaluation."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from motorwatch.operators import catalog, merge
from motorwatch.plans import corpus, evaluation, monitoring, reports, star, typed, warehouse
from motorwatch.plans.warehouse import EXPOSED, Warehouse
from motorwatch.querybook import feeds
from motorwatch.querybook.registry import Tables
from motorwatch.sources.feeds import FEEDS
from motorwatch.streaming.filters import accumulate_stream
from motorwatch.streaming.ingest import ingest_available, read_landed


def _raw(spark, table, rows):
    """Rows of a feed from partial dicts."""
    columns = FEEDS[table].columns
    return spark.createDataFrame(
        [tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns)
    )


RECALLS = [
    {"record_id": "1", "campno": "24V001", "maketxt": "TESLA", "modeltxt": "MODEL Y", "yeartxt": "2023", "compname": "ELECTRICAL:BATTERY", "potaff": "100", "odate": "20240301", "rcdate": "20240201", "rcltypecd": "V"},
    {"record_id": "2", "campno": "24V001", "maketxt": "TESLA", "modeltxt": "MODEL X", "yeartxt": "2023", "compname": "ELECTRICAL:BATTERY", "potaff": "100", "odate": "20240301", "rcdate": "20240201", "rcltypecd": "V"},
    {"record_id": "3", "campno": "24V002", "maketxt": "CHEVY", "modeltxt": None, "yeartxt": "", "compname": None, "potaff": "", "odate": "00000000", "rcdate": "", "rcltypecd": "E"},
    {"record_id": "3", "campno": "24V002", "maketxt": "CHEVY", "modeltxt": "", "yeartxt": "", "compname": "", "potaff": "", "odate": "", "rcdate": "", "rcltypecd": "E"},
]
COMPLAINTS = [
    {"cmplid": "1", "odino": "100", "maketxt": "TESLA", "modeltxt": "MODEL Y", "yeartxt": "2023", "crash": "Y", "fire": "", "injured": "2", "compdesc": "ELECTRICAL:BATTERY", "state": "CA", "faildate": "20240105", "cdescr": "Call 555-123-4567 please."},
    {"cmplid": "2", "odino": "100", "maketxt": "TESLA", "modeltxt": "MODEL Y", "yeartxt": "2023", "crash": "N", "fire": "Y", "injured": "", "compdesc": "AIR BAGS", "state": "CA", "faildate": "20240105", "cdescr": "Call 555-123-4567 please."},
    {"cmplid": "3", "odino": "101", "maketxt": "ACME", "modeltxt": "Z", "yeartxt": "1999", "compdesc": "STEERING", "state": "NY", "faildate": "19990105", "cdescr": "word " * 400},
    {"cmplid": "4", "odino": "102", "maketxt": "", "modeltxt": "Z", "yeartxt": "1999", "compdesc": "STEERING", "state": "NY", "faildate": "", "cdescr": ""},
]
INVESTIGATIONS = [
    {"nhtsa_action_number": "PE22001", "maketxt": "TESLA", "modeltxt": "MODEL Y", "yeartxt": "2023", "component_name": "STEERING", "mfr_name": "TESLA, INC.", "action_open_date": "20220101", "summary": "s"},
    {"nhtsa_action_number": "PE22001", "maketxt": "TESLA", "modeltxt": "MODEL X", "yeartxt": "2023", "component_name": "STEERING", "mfr_name": "TESLA, INC.", "action_open_date": "20220101", "summary": "s"},
    {"nhtsa_action_number": "EA20002", "maketxt": "FORD", "modeltxt": "F-150", "yeartxt": "2015", "component_name": "BRAKES", "mfr_name": "Ford", "action_open_date": "20200101", "action_close_date": "20200131", "summary": "t"},
]
BULLETINS = [
    {"nhtsa_item_number": "10", "tsb_id": "SB1", "maketxt": "KIA", "modeltxt": "SOUL", "yeartxt": "2020", "component_desc": c, "orig_date": "20210601", "summary": "Replace the cooler."}
    for c in ("ENGINE", "EGR")
]


@pytest.fixture(scope="module")
def house(spark):
    w = Warehouse(spark, "fleet")
    for table, rows in (
        ("bronze_recalls", RECALLS), ("bronze_complaints", COMPLAINTS),
        ("bronze_investigations", INVESTIGATIONS), ("bronze_tsb_index", BULLETINS),
    ):
        for _ in range(2):
            merge.ingest(spark, FEEDS[table], _raw(spark, table, rows), "fleet", "run-1", "file://x")
    crashes = spark.createDataFrame(
        [("r1", "Waymo", "Level 4", "MAR-2024", "ADS hit a cone", "old.csv"), ("r1", "Waymo", "Level 4", "2024-03-02", "ADS hit a wall", "zz.csv")],
        "report_id string, make string, sae_automation_level string, incident_date string, narrative string, _sgo_source string",
    )
    merge.ingest(spark, FEEDS["bronze_sgo_crashes"], crashes, "fleet", "run-1", "file://x")
    w.build_typed()
    w.build_star()
    w.build_corpus(embedding_model="m")
    return w


def test_raw_tables_hold_each_key_once(house):
    counts = {t: house.table(t).count() for t in FEEDS if house.has(t)}
    assert counts == {"bronze_recalls": 3, "bronze_complaints": 4, "bronze_investigations": 3, "bronze_tsb_index": 2, "bronze_sgo_crashes": 1}
    raw = json.loads(house.table("bronze_recalls").where("record_id = '1'").first()["_raw"])
    assert raw["campno"] == "24V001" and "notes" in raw and raw["notes"] is None
    assert house.table("bronze_sgo_crashes").first()["narrative"] == "ADS hit a wall"


def test_typed_tables(house):
    complaint = house.table("silver_complaints").where("complaint_id = '1'").first()
    assert complaint["narrative_clean"] == "Call [PHONE] please." and complaint["narrative_len_orig"] == 25
    assert (complaint["crash"], complaint["fire"], complaint["injured"]) == (True, False, 2)
    cases = {r["nhtsa_action_number"]: r for r in house.table("silver_investigations").collect()}
    assert (cases["EA20002"]["status"], cases["EA20002"]["days_open"]) == ("closed", 30)
    assert cases["PE22001"]["status"] == "open" and cases["PE22001"]["oem_group"] == "Tesla"
    crash = house.table("silver_sgo_crashes").first()
    assert (crash["sae_level"], crash["incident_date_d"]) == ("L4", dt.date(2024, 3, 2))
    assert "model_year=2023" in house.table("silver_complaints").inputFiles()[0] or house.table("silver_complaints").where("model_year = 2023").count() == 2


def test_star_keys_meet_their_dimensions(house):
    for fact in ("gold_recalls_fact", "gold_complaints_fact", "gold_tsbs_fact"):
        rows = house.table(fact)
        for dim, key in (("dim_vehicle", "vehicle_key"), ("dim_component", "component_id"), ("dim_oem_group", "oem_group_id")):
            table = house.table(dim)
            assert table.select(key).distinct().count() == table.count(), dim
            assert rows.join(table, key).count() == rows.count(), (fact, dim)
    cases = house.table("gold_investigations_fact")
    assert cases.join(house.table("dim_component"), "component_id").count() == cases.count()
    assert house.table("gold_sgo_av_crashes").columns == ["report_id", "vehicle_key", "oem_group_id", "event_date", "sae_level", "sgo_source", "narrative"]


def test_calendar_spans_from_first_event_to_today(house):
    row = house.table("dim_date").agg(F.min("date_key"), F.max("date_key"), F.count("*"), F.count_if("is_today")).first()
    assert row[0] == dt.date(1999, 1, 5) and row[1] >= dt.date.today() - dt.timedelta(days=1)
    assert row[2] == (row[1] - row[0]).days + 1 and row[3] <= 1


def test_fan_out_safe_figures(house):
    fact = house.table("gold_recalls_fact")
    assert reports.deduplicated_sum(fact, "campaign_number", "units_affected", "u").first()[0] == 100
    top = reports.top_by_distinct(fact, house.table("dim_oem_group"), "oem_group_id", "oem_group", "campaign_number", "n")
    assert [tuple(r) for r in top.collect()] == [("General Motors", 1), ("Tesla", 1)]
    assert reports.campaigns_for(fact, house.table("dim_vehicle"), "Tesla", 2024).first()[0] == 1
    assert reports.deduplicated_sum(fact.where("false"), "campaign_number", "units_affected", "u").first()[0] == 0
    active = reports.active_cases(house.table("gold_investigations_fact"), house.table("dim_oem_group"), house.table("dim_component"))
    assert [(r["action_number"], r["oem"], r["component"]) for r in active.collect()] == [("PE22001", "Tesla", "Steering")]


def test_corpus(house):
    chunks = house.table("gold_narrative_chunks")
    assert tuple(chunks.columns) == corpus.CHUNK_COLUMNS
    assert chunks.select("chunk_id").distinct().count() == chunks.count()
    per_source = {r["source_dataset"]: r["count"] for r in chunks.groupBy("source_dataset").count().collect()}
    assert per_source == {"complaints": 4, "tsb": 1, "sgo": 1}
    assert chunks.where("content LIKE '%555%'").count() == 0


def test_corpus_from_parsed_texts_and_samples(spark, house):
    spark.createDataFrame([("SB1", "parsed bulletin"), ("SB9", "unknown bulletin")], "doc_id string, full_text string").write.mode("overwrite").saveAsTable("fleet.silver_tsb_parsed")
    spark.createDataFrame([("PE22001__abc", "case text")], "doc_id string, full_text string").write.mode("overwrite").saveAsTable("fleet.silver_investigation_parsed")
    house.build_corpus(embedding_model="m")
    rows = {(r["source_dataset"], r["source_id"]): r for r in house.table("gold_narrative_chunks").collect()}
    assert rows["tsb", "SB1"]["make_norm"] == "Kia" and rows["tsb", "SB9"]["make_norm"] is None
    assert rows["investigation", "PE22001__abc"]["make_norm"] == "Tesla"
    n_dated = house.table("gold_narrative_chunks").where("event_date >= '2016-01-01'").count()
    house.resample_corpus({"post_2015": 3, "pre_2000": 1})
    after = house.table("gold_narrative_chunks").groupBy(corpus.date_bucket().alias("b")).count()
    assert n_dated > 3 and {r["b"]: r["count"] for r in after.collect()} == {"post_2015": 3, "pre_2000": 1}
    house.build_corpus(embedding_model="m", sample_per_source={"tsb": 10})
    assert {r[0] for r in house.table("gold_narrative_chunks").select("source_dataset").collect()} == {"tsb"}
    for t in ("silver_tsb_parsed", "silver_investigation_parsed"):
        spark.sql(f"DROP TABLE fleet.{t}")


def test_chunk_ids_stay_unique_when_one_id_has_several_texts(frame):
    rows = [("1", "a"), ("1", "a"), ("1", "b"), ("1", ""), (None, "a"), (None, "c"), ("2", "a"), ("2", ""), ("2", None)]
    typed_rows = frame(rows, "tsb_id string, summary string").selectExpr(
        "tsb_id", "summary", *[f"CAST(NULL AS string) AS {c}" for c in ("make_norm", "model_norm", "component_group", "oem_group")],
        "CAST(NULL AS int) AS model_year", "CAST(NULL AS date) AS original_date",
    )
    source = corpus.from_bulletins(typed_rows)
    got = corpus.narrative_chunks([source]).collect()
    assert sorted((r["source_id"] or "", r["content"]) for r in got) == [("", "a"), ("", "c"), ("1", "a"), ("1", "b"), ("2", "a")]
    assert len({r["chunk_id"] for r in got}) == 5
    plain = {r["chunk_id"] for r in corpus.narrative_chunks([source], unique=False).collect()}
    assert len(plain) == 3 and plain <= {r["chunk_id"] for r in got}


def test_texts_are_told_apart_source_by_source_and_leave_no_shuffles(spark, frame, monkeypatch):
    written, freed = [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def watched(df, label, compression=None, really=corpus.stage):
        written.append((label, spark.conf.get(freed)))
        return really(df, label, compression)

    monkeypatch.setattr(corpus, "stage", watched)
    typed_rows = frame(
        [("SB1", "one", "B"), ("SB1", "one", "A"), ("SB1", "two", None), (None, "one", None), (None, "one", None), ("SB2", "", None)],
        "tsb_id string, summary string, make_norm string",
    ).selectExpr("*", "'m' AS model_norm", "1 AS model_year", "'c' AS component_group", "'g' AS oem_group", "DATE '2020-01-01' AS original_date")
    rows = corpus.narrative_chunks([corpus.from_bulletins(typed_rows), None, corpus.from_bulletins(typed_rows.where("tsb_id = 'SB1'"))]).collect()
    assert sorted((r["source_id"] or "", r["content"], r["make_norm"] or "") for r in rows) == [("", "one", ""), ("SB1", "one", "A"), ("SB1", "two", "")]
    assert len({r["chunk_id"] for r in rows}) == 3
    assert written == [("texts", "true"), ("texts", "true"), ("chosen-texts", "true")]
    assert spark.conf.get(freed) == "false"


def test_joins_below_the_feeds_go_once_they_are_taken_in(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    feeds.write_lines(t, "supplied")
    rows, files = t.made("supplied", lambda: None).count(), t.made("supplied", lambda: None).inputFiles()
    feeds.drop_lines(t, "supplied")
    assert files and not any(os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in files)
    assert feeds.supplied(t).count() == rows  # made anew from the tables


def test_bulletins_are_typed_where_they_lie(spark, house, monkeypatch):
    asked, really = [], catalog.rebuild

    def watched(df, table, partition_by=None, dealt=False):
        asked.append((table, partition_by, dealt))
        return really(df, table, partition_by, dealt)

    monkeypatch.setattr(warehouse, "rebuild", watched)
    before = _rows_of(house, "silver_tsbs")
    house.build_typed()
    assert ("fleet.silver_tsbs", "bulletin_year", True) in asked
    assert _rows_of(house, "silver_tsbs") == before


def _rows_of(house, table):
    return sorted(map(str, house.table(table).drop("_silver_at").collect()))


def test_comments_and_contract(spark, house):
    assert house.comment() == 25
    described = {r["col_name"]: r["comment"] for r in spark.sql("DESCRIBE fleet.dim_vehicle").collect()}
    assert described["model_year"] == "Four-digit year."
    status = {r["table_name"]: (r["present"], r["queryable"]) for r in house.check_contract().collect()}
    assert set(status) == set(EXPOSED) and set(status.values()) == {(True, True)}
    gone = catalog.contract(spark, {"x": "fleet.no_such_table"}).first()
    assert (gone["present"], gone["queryable"]) == (False, False)
    assert catalog.apply_comments(spark, ["COMMENT ON TABLE fleet.nope IS 'x'"]) == 0
    with pytest.raises(RuntimeError):
        catalog.existing(spark, ["fleet.nope"])


def test_replacing_a_table_by_itself(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS swap")
    spark.range(10).write.mode("overwrite").saveAsTable("swap.t")
    catalog.replace_with(spark, "swap.t", spark.table("swap.t").where("id < 4"))
    assert spark.table("swap.t").count() == 4
    assert [r["tableName"] for r in spark.sql("SHOW TABLES IN swap").collect()] == ["t"]


def test_crash_snapshot_without_its_key(frame):
    with pytest.raises(ValueError, match="report_id"):
        typed.av_crashes(frame([("x",)], "make string"))
    assert corpus.from_av_crashes(typed.av_crashes(frame([("1",)], "report_id string"))) is None


def test_null_and_empty_text_share_one_dimension_row(frame):
    rows = frame([(None, "m", 1), ("", "m", 1), ("A", None, None)], "make_norm string, model_norm string, model_year int")
    dim = star.dim_vehicle(rows)
    assert dim.count() == 2 and dim.select("vehicle_key").distinct().count() == 2


# ----------------------------------------------------------------- streaming


def test_files_land_once_whatever_is_rerun(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    schema = "id string, v string"
    spark.createDataFrame([("1", "a"), ("1", "b"), (None, "n")], schema).write.csv(str(source / "one"))
    struct = spark.createDataFrame([], schema).schema

    def run(checkpoint):
        files = spark.readStream.schema(struct).option("maxFilesPerTrigger", 1).csv(str(source / "*"))
        ingest_available(spark, files, ["id"], target, str(tmp_path / checkpoint), order=["v"])
        return sorted((r["id"] or "", r["v"]) for r in read_landed(spark, target, struct).collect())

    assert read_landed(spark, target, struct).count() == 0
    first = run("c1")
    assert [k for k, _ in first] == ["", "1"]
    assert run("c1") == first
    spark.createDataFrame([("2", "c"), ("1", "z")], schema).write.csv(str(source / "two"))
    second = run("c1")
    assert set(first) < set(second) and len(second) == 3
    assert sorted(k for k, _ in run("c2")) == ["", "1", "2"]


def test_filters_follow_the_stream(spark, tmp_path):
    source = tmp_path / "turns"
    schema = "session_id string, turn_idx bigint, filters string"

    def add(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(source / name))

    add("one", [("s", 1, '{"years":[2021]}'), ("s", 0, '{"make":"Tesla","years":[2020]}'), ("t", 0, None)])
    add("two", [("s", 2, '{"make":null,"years":[2020,2022]}')])
    stream = spark.readStream.schema(schema).json(str(source / "*"))
    query = (
        accumulate_stream(stream).writeStream.outputMode("update").format("memory").queryName("bags")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.table("bags").collect()
    bags = {r["session_id"]: json.loads(r["filters"]) for r in sorted(rows, key=lambda r: r["turn_idx"])}
    assert bags == {"s": {"years": [2020, 2021, 2022]}, "t": {}}


# ------------------------------------------------------ monitoring, evaluation

_TRACE = """trace_id string, request_time timestamp, request_preview string, response string, execution_duration_ms bigint,
  tags map<string,string>, spans array<struct<name:string,attributes:map<string,string>>>,
  assessments array<struct<name:string,feedback:struct<value:string>>>"""


def _trace(trace_id, response=None, spans=(), assessments=None, tags=None):
    when = dt.datetime(2024, 1, 1, 10, 0)
    return (trace_id, when, "q", response, 1500, tags or {"session_id": "s"}, [(n, a) for n, a in spans], assessments)


def test_trace_view(frame):
    message = json.dumps({"output": [{"type": "reasoning"}, {"type": "message", "content": [{"text": "See PE22-001, Tesla"}]}]})
    usage = json.dumps({"usage": {"total_tokens": 7}})
    rows = [
        _trace("full", message, [("call_llm", {"mlflow.spanOutputs": usage}), ("X._call_llm", {"mlflow.spanOutputs": "{}"}), ("tool.fetch_tsb", {}), ("execute_tool", None)],
               [("cite_id_present", ("true",)), ("factual_defect", ('"no"',)), ("stays_in_scope", ('"yes"',))]),
        _trace("untold", '{"output":[]}', [("call_llm", {})], []),
        _trace("spanless", message),
    ]
    traces = frame(rows, _TRACE)
    view = {r["trace_id"]: r for r in monitoring.trace_view(traces).collect()}
    assert set(view) == {"full", "untold"}
    full = view["full"]
    assert (full["response_text"], full["latency_seconds"], full["session_id"]) == ("See PE22-001, Tesla", 1.5, "s")
    assert (full["call_llm_exec_count"], full["tool_call_count"], full["fetch_tsb_count"], full["genie_call_count"]) == (2, 2, 1, 0)
    assert full["total_tokens_used"] == 7
    assert (full["cite_id_present"], full["mentions_oem"], full["factual_defect"], full["stays_in_scope"], full["cite_every_claim"]) == (1, 0, 0, 1, None)
    assert view["untold"]["response_text"] is None and view["untold"]["total_tokens_used"] is None
    kept = {r["trace_id"]: r for r in monitoring.trace_view(traces, keep_spanless=True).collect()}
    assert kept["spanless"]["tool_call_count"] == 0
    rows = traces.select("trace_id", F.explode("spans").alias("s")).select("trace_id", "s.*")
    exploded = {r["trace_id"]: r for r in monitoring.counts_from_span_rows(rows).collect()}
    for name in ("call_llm_exec_count", "tool_call_count", "fetch_tsb_count", "total_tokens_used"):
        assert {t: r[name] for t, r in exploded.items()} == {t: r[name] for t, r in view.items()}, name
    waiting = monitoring.cheap_scores(monitoring.unscored(traces)).collect()
    assert [(r["trace_id"], r["cite_id_present"], r["mentions_oem"]) for r in waiting] == [("spanless", True, True)]


def test_registered_view_answers_sql(spark, frame):
    frame([_trace("a", None, [("call_llm", {})])], _TRACE).createOrReplaceTempView("raw_traces")
    monitoring.register_trace_view(spark, "raw_traces", "agent_traces")
    assert spark.sql("SELECT call_llm_exec_count FROM agent_traces").first()[0] == 1


def test_retrieval_gate_with_latencies(frame):
    rows = [(f"q{i}", 8, i >= 2, float(10 * i)) for i in range(10)]
    got = evaluation.retrieval_gate(frame(rows, "query_id string, n_hits int, hit boolean, ms double"), F.col("hit"), "ms").first()
    assert (got["n_queries"], got["n_pass"], got["ok"], got["avg_hits"]) == (10, 8, True, 8.0)
    assert got["p50_ms"] == 45.0 and got["p95_ms"] == pytest.approx(85.5)


def _results(frame, rows):
    schema = "tier string, question string, score double, passed boolean, pending boolean, latency_s double, n_tool_calls int, n_llm_calls int, stopped_reason string"
    return frame(rows, schema)


def test_tier_metrics_and_gate(frame):
    rows = [("tier1", f"q{i}", 1.0, i < 3, i == 4, float(i), 2, 1, "ok" if i else "error") for i in range(5)]
    rows += [("tier3", "z", 4.0, True, False, 2.0, 0, 1, "ok"), ("tier3", "y", 3.0, False, False, 4.0, 0, 2, "ok")]
    metrics = evaluation.tier_metrics(_results(frame, rows))
    got = {r["tier"]: r for r in metrics.collect()}
    one = got["tier1"]
    assert (one["n"], one["n_scored"], one["n_pending"], one["pass_rate"], one["tier1_exact_match_rate"]) == (5, 4, 1, 0.75, 0.75)
    assert (one["mean_latency_seconds"], one["p95_latency_seconds"], one["error_rate"]) == (2.0, 4.0, 0.2)
    assert got["tier3"]["tier3_avg_judge_score"] == 3.5 and one["tier3_avg_judge_score"] is None
    evaluation.assert_promotable(metrics)
    broken = metrics.withColumn("error_rate", F.lit(0.5))
    assert evaluation.gate(broken).count() == 2
    with pytest.raises(AssertionError, match="error_rate"):
        evaluation.assert_promotable(broken)
    with pytest.raises(AssertionError, match="no tiers"):
        evaluation.assert_promotable(metrics.where("false"))
    worst = evaluation.worst(_results(frame, rows), 2)
    assert [r["question"] for r in worst.collect()] == ["y", "z"] or worst.first()["score"] <= 3.0


def test_all_pending_counts_no_passes(frame):
    row = evaluation.tier_metrics(_results(frame, [("tier1", "q", 0.0, False, True, 1.0, 0, 0, "ok")])).first()
    assert (row["n_scored"], row["pass_rate"]) == (0, 0.0)


def test_ground_truth_join(frame):
    results = frame([("tier1", "a"), ("tier1", "b"), ("tier2", "a")], "tier string, question string")
    truth = frame([("tier1", "a", "TBD:x"), ("tier2", "c", "1")], "tier string, question string, expected_value string")
    got = {(r["tier"], r["question"]): (r["_matched"], r["is_pending"]) for r in evaluation.with_ground_truth(results, truth).collect()}
    assert got == {("tier1", "a"): (True, True), ("tier1", "b"): (False, False), ("tier2", "a"): (False, False)}


@pytest.mark.parametrize("limit", [0, 1000])
def test_rows_with_a_key_of_their_own_are_not_moved_by_a_merge(spark, frame, plan, monkeypatch, limit):
    monkeypatch.setattr(merge, "BROADCAST_KEYS", limit)
    rows = [("a", None, "1"), (None, "a", "2"), (None, None, "4"), (None, None, "3"), ("a", "b", "6"), ("a", "b", "5"), ("ab", "", "7"), ("", "ab", "8")]
    batch = frame(rows, "k string, l string, v string")
    empty, some = batch.limit(0), frame([("a", "b", "0"), (None, "a", "0")], "k string, l string, v string")
    for target in (empty, some):
        for keep in ("first", "last"):
            chosen = merge.new_rows_by_hash(batch, target, ["k", "l"], ["v"], keep)
            want = merge.new_rows(batch, target, ["k", "l"], ["v"], keep)
            assert sorted(map(repr, chosen.collect())) == sorted(map(repr, want.collect()))
    if limit:
        # Only the rows that share a key are dealt by it, below a join that finds few of them.
        text = plan(merge.new_rows_by_hash(batch, empty, ["k", "l"], ["v"]))
        assert text.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in text and "LeftAnti" in text


def test_raw_rows_come_back_whole_from_compressed_tables(spark, house):
    for table in ("bronze_recalls", "silver_recalls", "gold_recalls_fact"):
        assert all(".zstd." in f for f in house.table(table).inputFiles()), table
