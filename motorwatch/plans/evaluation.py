"""Evaluation runs: scoring, per-tier metrics, triage, the promotion gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import is_pending, triage_bucket
from ..operators.merge import one_per_key
from ..operators.quantiles import exact_quantile

MAX_ERROR_RATE = 0.2


def with_ground_truth(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Results joined to the question set by exact text; ``_matched`` marks those found."""
    truth = questions.drop("tier") if "tier" in questions.columns and "tier" not in results.columns else questions
    on = [c for c in ("tier", "question") if c in truth.columns and c in results.columns]
    extra = [c for c in truth.columns if c not in on]
    truth = one_per_key(truth, on, extra).withColumn("_hit", F.lit(True))
    joined = results.join(truth, on, "left")
    out = joined.withColumn("_matched", F.coalesce("_hit", F.lit(False))).drop("_hit")
    if "expected_value" in extra:
        out = out.withColumn("is_pending", F.col("_matched") & is_pending("expected_value"))
    return out


def tier_metrics(results: DataFrame) -> DataFrame:
    """Per tier: counts, pass rate over scored rows, latency, calls, error rate, tier's own metric.

    Pending rows count in ``n`` but not in the pass rate. One grouping plus the exact
    nearest-rank 95th percentile of latency.
    """
    scored = ~F.col("pending")
    metrics = results.groupBy("tier").agg(
        F.count("*").alias("n"),
        F.count_if(scored).alias("n_scored"),
        F.count_if(F.col("pending")).alias("n_pending"),
        F.count_if(scored & F.col("passed")).alias("_passes"),
        F.avg("latency_s").alias("_latency"),
        F.avg("n_tool_calls").alias("_tools"),
        F.avg("n_llm_calls").alias("_llm"),
        F.count_if(~F.col("stopped_reason").eqNullSafe(F.lit("ok"))).alias("_errors"),
        F.avg(F.when(scored, F.col("score"))).alias("_score"),
    )
    p95 = exact_quantile(results, "latency_s", 0.95, ["tier"], method="nearest", name="_p95")
    joined = metrics.join(p95, "tier", "left")
    pass_rate = F.round(F.col("_passes") / F.greatest(F.col("n_scored"), F.lit(1)), 4)
    return joined.select(
        "tier", "n", "n_scored", "n_pending",
        pass_rate.alias("pass_rate"),
        F.round("_latency", 3).alias("mean_latency_seconds"),
        F.round(F.coalesce("_p95", F.lit(0.0)), 3).alias("p95_latency_seconds"),
        F.round("_tools", 2).alias("mean_tool_calls"),
        F.round("_llm", 2).alias("mean_llm_calls"),
        F.round(F.col("_errors") / F.col("n"), 4).alias("error_rate"),
        F.when(F.col("tier") == "tier1", pass_rate).alias("tier1_exact_match_rate"),
        F.when(F.col("tier") == "tier2", pass_rate).alias("tier2_grounded_pass_rate"),
        F.when(F.col("tier") == "tier3", F.round(F.coalesce("_score", F.lit(0.0)), 3)).alias("tier3_avg_judge_score"),
    )


def triage(results: DataFrame, cite_ok: Column, judge: Column) -> DataFrame:
    """Failure buckets of the answers that did not pass, with their counts."""
    failed = results.where(~F.col("passed"))
    bucket = triage_bucket(cite_ok, judge, "source_id", "answer").alias("bucket")
    return failed.groupBy(bucket).agg(F.count("*").alias("n"))


def worst(results: DataFrame, k: int = 2, ties: Sequence[str] = ("question",)) -> DataFrame:
    """The ``k`` lowest scores, a missing score counting as 0."""
    return results.orderBy(F.coalesce("score", F.lit(0.0)), *ties).limit(k)


def gate(metrics: DataFrame) -> DataFrame:
    """Why a run may not be promoted, one row per finding; empty means it may."""
    problems = F.array_compact(
        F.array(
            F.when(F.col("n") == 0, F.concat("tier", F.lit(": zero questions"))),
            F.when(
                F.col("error_rate") > MAX_ERROR_RATE,
                F.concat("tier", F.lit(": error_rate="), F.col("error_rate").cast("string"), F.lit(" > 0.2")),
            ),
        )
    )
    return metrics.select("tier", F.explode(problems).alias("issue"))


def assert_promotable(metrics: DataFrame) -> None:
    """An error that names every finding, two per tier at most."""
    if metrics.isEmpty():
        raise AssertionError("no tiers were run")
    issues = gate(metrics).agg(F.array_join(F.array_sort(F.collect_list("issue")), "; ")).first()[0]
    if issues:
        raise AssertionError(issues)


# Fixed value: smoke queries that must succeed out of ten.
RETRIEVAL_PASS_SHARE = 0.8


def retrieval_gate(top_hits: DataFrame, passed: Column, latency_ms: str | None = None) -> DataFrame:
    """Pass count and verdict over the best hit of every smoke query."""
    out = top_hits.agg(
        F.count("*").alias("n_queries"), F.count_if(passed).alias("n_pass"), F.avg("n_hits").alias("avg_hits")
    ).withColumn("ok", F.col("n_pass") >= F.ceil(F.col("n_queries") * F.lit(RETRIEVAL_PASS_SHARE)))
    if latency_ms:
        for label, q in (("p50_ms", 0.5), ("p95_ms", 0.95)):
            value = exact_quantile(top_hits, latency_ms, q, name=label)
            out = out.withColumn(label, value.scalar())
    return out
