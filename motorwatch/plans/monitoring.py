"""Agent traces: the per-trace view, what is still unscored, and the dashboard's numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import cite_id_present, mentions_any, word_count_under
from ..functions.text import strip
from ..functions.traces import SpanNames, flag, judged, response_text, span_counts, token_total
from ..operators.catalog import rebuild
from ..operators.quantiles import exact_quantile
from ..operators.sampling import exact_size
from ..session import stage

CHEAP_SCORES = ("cite_id_present", "word_count_under", "mentions_oem")
JUDGED_SCORES = ("factual_defect", "cite_every_claim", "stays_in_scope")


def trace_view(
    traces: DataFrame, endpoint: str | None = None, names: SpanNames = SpanNames(), keep_spanless: bool = False
) -> DataFrame:
    """One row per trace with counters, tokens and scores; row-local, no shuffle.

    Traces without spans are left out unless ``keep_spanless``.
    """
    df = traces if endpoint is None else traces.where(F.col("tags")["model_serving_endpoint_name"] == endpoint)
    if not keep_spanless:
        df = df.where(F.size("spans") > 0)
    spans, assessments = F.coalesce("spans", F.array()), F.col("assessments")
    return df.select(
        "trace_id",
        "request_time",
        "request_preview",
        response_text("response").alias("response_text"),
        (F.col("execution_duration_ms") / 1000.0).cast("double").alias("latency_seconds"),
        F.col("tags")["session_id"].alias("session_id"),
        *[c.alias(n) for n, c in span_counts(spans, names).items()],
        token_total(spans, names).alias("total_tokens_used"),
        F.current_timestamp().alias("processed_ts"),
        *[flag(assessments, n).alias(n) for n in CHEAP_SCORES],
        *[judged(assessments, n).alias(n) for n in JUDGED_SCORES],
    )


def register_trace_view(spark: SparkSession, traces_table: str, view: str, endpoint: str | None = None) -> None:
    """Put the per-trace view under a name, for dashboards' SQL in this session."""
    trace_view(spark.table(traces_table), endpoint).createOrReplaceTempView(view)


def publish_trace_table(spark: SparkSession, traces_table: str, table: str, endpoint: str | None = None) -> None:
    """The per-trace view as a table of the catalog, for dashboards in other sessions; rebuilt on each call."""
    rebuild(trace_view(spark.table(traces_table), endpoint), table)


def counts_from_span_rows(
    spans: DataFrame, trace: str = "trace_id", name: str = "name", attributes: str = "attributes", names: SpanNames = SpanNames()
) -> DataFrame:
    """The counters of :func:`trace_view` for spans stored one per row.

    Counts and sums combine before the shuffle, so a trace with very many spans stays cheap.
    """
    span = F.col(name)
    tokens = F.when(names.is_model_call(span), names.tokens(F.col(attributes))).otherwise(F.lit(0))
    return spans.groupBy(trace).agg(
        F.count_if(names.is_model_call(span)).alias("call_llm_exec_count"),
        F.count_if(names.is_tool_call(span)).alias("tool_call_count"),
        *[F.count_if(span == tool).alias(label) for label, tool in names.tools],
        F.sum(tokens.cast("bigint")).alias("total_tokens_used"),
    )


def unscored(traces: DataFrame, endpoint: str | None = None) -> DataFrame:
    """Traces without any assessment whose response has text, with that text."""
    df = traces if endpoint is None else traces.where(F.col("tags")["model_serving_endpoint_name"] == endpoint)
    df = df.where(F.col("assessments").isNull() | (F.size("assessments") == 0))
    out = df.select("trace_id", "request_preview", response_text("response").alias("response_text"))
    return out.where(strip(F.coalesce("response_text", F.lit(""))) != "")


def cheap_scores(answers: DataFrame, text: str = "response_text") -> DataFrame:
    """The three text-only scores of every answer."""
    return answers.withColumns(
        {
            "cite_id_present": cite_id_present(text),
            "word_count_under": word_count_under(text),
            "mentions_oem": mentions_any(text),
        }
    )


def judge_sample(answers: DataFrame, ids: list[str], share: float = 0.1, seed: int = 42) -> DataFrame:
    """The share of answers given to a judge, at least one, the same on every run.

    The answers, often a view that parses JSON, are worked out once and written; drawing reads them three times.
    """
    answers = stage(answers, "answers")
    size = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share)))
    return exact_size(answers, ids, size, seed=seed)


def kpi_counts(view: DataFrame) -> DataFrame:
    return view.agg(
        F.count("trace_id").alias("count_traces"),
        F.avg("cite_id_present").alias("cite_rate"),
        F.avg("mentions_oem").alias("oem_rate"),
    )


def p95_latency(view: DataFrame) -> DataFrame:
    return exact_quantile(view, "latency_seconds", 0.95, name="p95_latency")


def over_time(view: DataFrame, unit: str, time: str = "request_time", **metrics) -> DataFrame:
    """Aggregates per time bucket, e.g. ``over_time(v, "HOUR", avg_cite=F.avg("cite_id_present"))``."""
    bucket = F.date_trunc(unit, F.col(time)).alias("bucket")
    return view.groupBy(bucket).agg(*[c.alias(n) for n, c in metrics.items()]).orderBy("bucket")


def tool_mix(view: DataFrame, names: SpanNames = SpanNames()) -> DataFrame:
    return view.agg(*[F.sum(c).alias(c.replace("_call_count", "_total").replace("_count", "_total")) for c, _ in names.tools])


def judged_rates(view: DataFrame) -> DataFrame:
    return view.agg(*[F.avg(n).alias(f"{n}_rate") for n in JUDGED_SCORES])


def latest(view: DataFrame) -> DataFrame:
    columns = (
        "trace_id", "request_time", "session_id", "latency_seconds", "tool_call_count",
        "cite_id_present", "mentions_oem", "total_tokens_used",
    )
    return view.select(*columns).orderBy(F.col("request_time").desc())
