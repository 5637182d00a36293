"""Agent traces, made row by row from the events, and the numbers watched over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calls import textual_call
from ..functions.traces import any_response_text, flag, judged, response_text
from ..operators.quantiles import exact_quantile
from ..plans import monitoring
from ..session import scratch_path
from ..streaming import scoring
from .registry import Tables, query

# Span names by position; four tools, two spellings of a model call, other spans.
SPANS = (
    "call_llm", "Agent._call_llm", "tool.genie_recalls", "tool.vector_search_narrative", "tool.fetch_tsb",
    "tool.fetch_investigation", "execute_tool", "plan",
)

# The events' props are always {"k": <number>}; cut out rather than parsed, as it is used many times per row.
_K = "CAST(substring(props, 7, length(props) - 7) AS int)"
_TEXTS = {
    0: "'Campaign 23V' || (100000 + user_id) || ' concerns Tesla and ' || event_type",
    1: "'No source for ' || event_type || ' of the frame'",
}
_RESPONSE = f"""CASE k % 4
  WHEN 0 THEN '{{"output":[{{"type":"reasoning"}},{{"type":"message","content":[{{"text":"' || {_TEXTS[0]} || '"}}]}},{{"type":"message","content":[{{"text":"later"}}]}}]}}'
  WHEN 1 THEN '{{"output":[{{"type":"message","content":[{{"text":"' || {_TEXTS[1]} || '"}}]}}]}}'
  WHEN 2 THEN '{{"output":[{{"type":"reasoning"}}]}}'
  ELSE 'not json' END"""
_NOTES = """CASE k % 5
  WHEN 1 THEN array()
  WHEN 2 THEN array(named_struct('name', 'cite_id_present', 'feedback', named_struct('value', 'true')),
                    named_struct('name', 'factual_defect', 'feedback', named_struct('value', '"yes"')))
  WHEN 3 THEN array(named_struct('name', 'mentions_oem', 'feedback', named_struct('value', 'true')),
                    named_struct('name', 'word_count_under', 'feedback', named_struct('value', 'false')),
                    named_struct('name', 'factual_defect', 'feedback', named_struct('value', '"no"')),
                    named_struct('name', 'stays_in_scope', 'feedback', named_struct('value', '"yes"')))
  WHEN 4 THEN array(named_struct('name', 'cite_every_claim', 'feedback', named_struct('value', '"maybe"')))
  END"""


def traces(t: Tables):
    names = ", ".join(f"'{n}'" for n in SPANS)
    spans = f"""CASE WHEN k % 6 = 0 THEN array() ELSE transform(sequence(1, k % 6), i -> named_struct(
        'name', element_at(array({names}), 1 + (k + i) % 8),
        'attributes', map('mlflow.spanOutputs', CASE WHEN k % 7 = 0 THEN '{{"usage":{{}}}}'
            ELSE '{{"usage":{{"total_tokens":' || (k * i) || '}}}}' END))) END"""
    return (
        t.events.withColumn("k", F.expr(_K))
        .select(
            F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("trace_id"),
            F.col("ts").alias("request_time"),
            F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("request_preview"),
            F.expr(_RESPONSE).alias("response"),
            F.round(F.col("value") * 1000).cast("bigint").alias("execution_duration_ms"),
            F.create_map(
                F.lit("session_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")),
                F.lit("model_serving_endpoint_name"), F.when(F.col("event_type") == "signup", "other").otherwise("agent"),
            ).alias("tags"),
            F.expr(spans).alias("spans"),
            F.expr(_NOTES).alias("assessments"),
        )
    )


_LIST = "[" + ", ".join(f"'{n}'" for n in SPANS) + "]"


def _len(test: str) -> str:
    return f"len(list_filter(names, lambda s: {test}))"


_TEXT_SQL = f"CASE k % 4 WHEN 0 THEN {_TEXTS[0]} WHEN 1 THEN {_TEXTS[1]} END"
SQL_VIEW = f"""ev AS (SELECT *, (props->>'$.k')::INTEGER AS k FROM events),
  sp AS (SELECT *, list_transform(range(1, k % 6 + 1), lambda i: {_LIST}[1 + (k + i) % 8]) AS names,
    list_transform(range(1, k % 6 + 1), lambda i: CASE WHEN (1 + (k + i) % 8) <= 2 THEN CASE WHEN k % 7 = 0 THEN NULL ELSE k * i END ELSE 0 END) AS toks FROM ev),
  v AS (SELECT 't' || event_id AS trace_id, ts AS request_time, event_type || ' ' || user_id AS request_preview, {_TEXT_SQL} AS response_text,
    round(value * 1000)::BIGINT / 1000.0::DOUBLE AS latency_seconds, 's' || user_id AS session_id,
    {_len("s IN ('call_llm', 'Agent._call_llm')")} AS call_llm_exec_count,
    {_len("s LIKE 'tool.%' OR s = 'execute_tool'")} AS tool_call_count,
    {_len("s = 'tool.genie_recalls'")} AS genie_call_count, {_len("s = 'tool.vector_search_narrative'")} AS vs_call_count,
    {_len("s = 'tool.fetch_tsb'")} AS fetch_tsb_count, {_len("s = 'tool.fetch_investigation'")} AS fetch_investigation_count,
    list_sum(toks)::BIGINT AS total_tokens_used,
    (k % 5 = 2)::INTEGER AS cite_id_present, 0 AS word_count_under, (k % 5 = 3)::INTEGER AS mentions_oem,
    CASE k % 5 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS factual_defect, NULL::INTEGER AS cite_every_claim, CASE k % 5 WHEN 3 THEN 1 END AS stays_in_scope
  FROM sp WHERE event_type <> 'signup' AND len(names) > 0)"""


def view(t: Tables):
    return monitoring.trace_view(traces(t), "agent")


@query("trace_view", f"WITH {SQL_VIEW} SELECT * REPLACE (round(latency_seconds, 6) AS latency_seconds) FROM v")
def trace_view(t: Tables):
    return view(t).drop("processed_ts").withColumn("latency_seconds", F.round("latency_seconds", 6))


_EXPLODED_SQL = f"""WITH {SQL_VIEW} SELECT trace_id, call_llm_exec_count, tool_call_count, genie_call_count, vs_call_count, fetch_tsb_count,
  fetch_investigation_count, total_tokens_used FROM v"""


@query("span_pivot", _EXPLODED_SQL)
def span_pivot(t: Tables):
    """The same counts from spans stored one per row, grouped by trace."""
    rows = traces(t).where(F.col("tags")["model_serving_endpoint_name"] == "agent")
    rows = rows.select("trace_id", F.explode("spans").alias("span")).select("trace_id", "span.*")
    return monitoring.counts_from_span_rows(rows)


@query(
    "span_counts_by_user",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type IN ('view', 'signup')) AS visits,
         sum(CASE WHEN event_type = 'error' THEN (props->>'$.k')::INTEGER ELSE 0 END)::BIGINT AS error_k FROM events GROUP BY user_id""",
)
def span_counts_by_user(t: Tables):
    """Conditional counts and sums per group, combined before the shuffle."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.count_if(F.col("event_type").isin("view", "signup")).alias("visits"),
        F.sum(F.when(F.col("event_type") == "error", k).otherwise(0)).alias("error_k"),
    )


@query(
    "json_token_sum",
    """SELECT event_type, sum(CASE WHEN value > 20 THEN (props->>'$.k')::INTEGER ELSE 0 END)::BIGINT AS tokens FROM events GROUP BY event_type""",
)
def json_token_sum(t: Tables):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.groupBy("event_type").agg(F.sum(F.when(F.col("value") > 20, k).otherwise(0)).alias("tokens"))


@query(
    "response_text",
    f"WITH ev AS (SELECT *, (props->>'$.k')::INTEGER AS k FROM events) SELECT 't' || event_id AS trace_id, {_TEXT_SQL} AS response_text FROM ev",
)
def response_texts(t: Tables):
    return traces(t).select("trace_id", response_text("response").alias("response_text"))


@query(
    "any_response_text",
    """SELECT event_id, CASE event_id % 6 WHEN 5 THEN 'bare ' || event_type ELSE event_type END AS text FROM events""",
)
def any_response_texts(t: Tables):
    shapes = (
        "'{\"text\":\"' || event_type || '\"}'",
        "'{\"content\":\"' || event_type || '\"}'",
        "'{\"output\":[{\"content\":[{\"text\":\"' || event_type || '\"}]}]}'",
        "'[\"' || event_type || '\", \"x\"]'",
        "'[{\"text\":\"' || event_type || '\"}]'",
        "'bare ' || event_type",
    )
    cases = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(shapes))
    raw = t.events.select("event_id", F.expr(f"CASE event_id % 6 {cases} END").alias("raw"))
    return raw.select("event_id", any_response_text("raw").alias("text"))


@query(
    "assessment_flags",
    """WITH ev AS (SELECT 't' || event_id AS trace_id, (props->>'$.k')::INTEGER AS k FROM events)
       SELECT trace_id, (k % 5 = 2)::INTEGER AS cite_id_present, 0 AS word_count_under, (k % 5 = 3)::INTEGER AS mentions_oem,
         CASE k % 5 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS factual_defect, NULL::INTEGER AS cite_every_claim FROM ev""",
)
def assessment_flags(t: Tables):
    notes = F.col("assessments")
    return traces(t).select(
        "trace_id",
        *[flag(notes, n).alias(n) for n in monitoring.CHEAP_SCORES],
        *[judged(notes, n).alias(n) for n in ("factual_defect", "cite_every_claim")],
    )


_UNSCORED_SQL = f"""WITH ev AS (SELECT *, (props->>'$.k')::INTEGER AS k FROM events), u AS (SELECT 't' || event_id AS trace_id,
          event_type || ' ' || user_id AS request_preview, {_TEXT_SQL} AS response_text, CASE k % 5 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 1 ELSE 0 END AS notes
          FROM ev WHERE event_type <> 'signup')
        SELECT * EXCLUDE (notes), regexp_matches(response_text, '[0-9]{{2}}V[0-9]{{3,}}') AS cite_id_present, TRUE AS word_count_under,
          (response_text LIKE '%Tesla%' OR response_text LIKE '%frame%') AS mentions_oem FROM u WHERE notes = 0 AND trim(coalesce(response_text, '')) <> ''"""


@query("unscored_traces", _UNSCORED_SQL)
def unscored_traces(t: Tables):
    """Traces still to be scored, with their text-only scores ("frame" holds "ram")."""
    return monitoring.cheap_scores(monitoring.unscored(traces(t), "agent"))


@query("scoring_stream", _UNSCORED_SQL)
def scoring_stream(t: Tables):
    """Traces arrive in two lots, of which the second holds the first once more: two triggers score each trace once."""
    source, target, progress = (scratch_path(t.spark, n) for n in ("traces", "scores", "score-progress"))
    every = traces(t)
    for lot in (every.where(F.crc32(F.col("trace_id").cast("binary")) % 2 == 0), every):
        lot.write.mode("append").parquet(source)
        arriving = t.spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 64).parquet(source)
        scoring.score_available(t.spark, arriving, target, progress, endpoint="agent")
    return scoring.read_scores(t.spark, target, monitoring.cheap_scores(monitoring.unscored(every, "agent")).schema)


@query(
    "judge_sample",
    f"""WITH ev AS (SELECT *, (props->>'$.k')::INTEGER AS k FROM events), u AS (SELECT 't' || event_id AS trace_id, {_TEXT_SQL} AS response_text,
            CASE k % 5 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 1 ELSE 0 END AS notes FROM ev WHERE event_type <> 'signup'),
        r AS (SELECT trace_id, row_number() OVER (ORDER BY md5('42|' || trace_id), trace_id) AS rn, count(*) OVER () AS n
          FROM u WHERE notes = 0 AND response_text IS NOT NULL)
        SELECT trace_id FROM r WHERE rn <= greatest(1, floor(n * 0.1))""",
)
def judge_sample(t: Tables):
    return monitoring.judge_sample(monitoring.unscored(traces(t), "agent").select("trace_id"), ["trace_id"])


@query("kpi_counts", f"WITH {SQL_VIEW} SELECT count(trace_id) AS count_traces, round(avg(cite_id_present), 9) AS cite_rate, round(avg(mentions_oem), 9) AS oem_rate FROM v")
def kpi_counts(t: Tables):
    out = monitoring.kpi_counts(view(t))
    return out.withColumns({c: F.round(c, 9) for c in ("cite_rate", "oem_rate")})


@query("p95_latency", f"WITH {SQL_VIEW} SELECT round(quantile_cont(latency_seconds, 0.95), 6) AS p95_latency FROM v")
def p95_latency(t: Tables):
    return monitoring.p95_latency(view(t)).withColumn("p95_latency", F.round("p95_latency", 6))


@query("median_by_type", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type")
def median_by_type(t: Tables):
    return exact_quantile(t.events, "value", 0.5, ["event_type"], name="median").withColumn("median", F.round("median", 6))


@query(
    "p95_nearest_rank",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
       SELECT event_type, value AS p95 FROM r WHERE i = round_even(0.95 * (n - 1)::DOUBLE, 0)""",
)
def p95_nearest_rank(t: Tables):
    return exact_quantile(t.events, "value", 0.95, ["event_type"], method="nearest", name="p95")


@query(
    "latency_over_time",
    f"WITH {SQL_VIEW} SELECT date_trunc('minute', request_time) AS bucket, round(avg(latency_seconds), 6) AS avg_latency FROM v GROUP BY 1",
)
def latency_over_time(t: Tables):
    return _as_ntz(monitoring.over_time(view(t), "MINUTE", avg_latency=F.round(F.avg("latency_seconds"), 6)))


def _as_ntz(df):
    return df.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(
    "tokens_over_time",
    f"WITH {SQL_VIEW} SELECT date_trunc('minute', request_time) AS bucket, sum(total_tokens_used)::BIGINT AS sum_tokens FROM v GROUP BY 1",
)
def tokens_over_time(t: Tables):
    return _as_ntz(monitoring.over_time(view(t), "MINUTE", sum_tokens=F.sum("total_tokens_used")))


@query(
    "calls_over_time",
    f"""WITH {SQL_VIEW} SELECT date_trunc('hour', request_time) AS bucket, round(avg(tool_call_count), 6) AS avg_tool_calls,
          round(avg(call_llm_exec_count), 6) AS avg_llm_calls, round(avg(cite_id_present), 6) AS avg_cite FROM v GROUP BY 1""",
)
def calls_over_time(t: Tables):
    metrics = {"avg_tool_calls": "tool_call_count", "avg_llm_calls": "call_llm_exec_count", "avg_cite": "cite_id_present"}
    return _as_ntz(monitoring.over_time(view(t), "HOUR", **{n: F.round(F.avg(c), 6) for n, c in metrics.items()}))


@query(
    "tool_mix",
    f"""WITH {SQL_VIEW} SELECT sum(genie_call_count)::BIGINT AS genie_total, sum(vs_call_count)::BIGINT AS vs_total, sum(fetch_tsb_count)::BIGINT AS fetch_tsb_total,
          sum(fetch_investigation_count)::BIGINT AS fetch_investigation_total FROM v""",
)
def tool_mix(t: Tables):
    return monitoring.tool_mix(view(t))


@query(
    "score_rates",
    f"""WITH {SQL_VIEW} SELECT round(avg(factual_defect), 9) AS factual_defect_rate, round(avg(cite_every_claim), 9) AS cite_every_claim_rate,
          round(avg(stays_in_scope), 9) AS stays_in_scope_rate FROM v""",
)
def score_rates(t: Tables):
    out = monitoring.judged_rates(view(t))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(
    "latest_traces",
    f"""WITH {SQL_VIEW} SELECT trace_id, request_time, session_id, round(latency_seconds, 6) AS latency_seconds, tool_call_count, cite_id_present, mentions_oem,
          total_tokens_used FROM v WHERE request_time > TIMESTAMP '2024-01-20 00:00:00'""",
)
def latest_traces(t: Tables):
    recent = view(t).where(F.col("request_time") > F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return monitoring.latest(recent).withColumn("latency_seconds", F.round("latency_seconds", 6))


_CALLS = {
    0: """'fetch_tsb(nhtsa_item_number="' || k || '")'""",
    1: """'  genie_recalls( {"question": "how many ' || event_type || '"} ) '""",
    2: """'unknown_tool(a="b")'""",
    3: """'See the list (with ' || k || ' entries) below.'""",
    4: """'vector_search_narrative(query="a", filters=' || chr(39) || 'f' || k || chr(39) || ', query="' || event_type || '")'""",
    5: """'fetch_tsb(' || k || ')'""",
}


@query(
    "textual_calls",
    """WITH ev AS (SELECT event_id, event_type, (props->>'$.k')::INTEGER AS k FROM events)
       SELECT event_id, CASE k % 6 WHEN 0 THEN 'fetch_tsb' WHEN 1 THEN 'genie_recalls' WHEN 4 THEN 'vector_search_narrative' END AS name,
         CASE k % 6 WHEN 0 THEN 'nhtsa_item_number=' || k WHEN 1 THEN 'question=how many ' || event_type
           WHEN 4 THEN 'filters=f' || k || ';query=' || event_type END AS args FROM ev""",
)
def textual_calls(t: Tables):
    cases = " ".join(f"WHEN {i} THEN {s}" for i, s in _CALLS.items())
    turns = t.events.withColumn("k", F.expr(_K)).select("event_id", F.expr(f"CASE k % 6 {cases} END").alias("content"))
    call = textual_call("content", ("genie_recalls", "vector_search_narrative", "fetch_tsb", "fetch_investigation"))
    pairs = F.transform(F.array_sort(F.map_entries("call.args")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return turns.select("event_id", call.alias("call")).select(
        "event_id", F.col("call.name").alias("name"), F.when(F.col("call").isNotNull(), F.array_join(pairs, ";")).alias("args")
    )
