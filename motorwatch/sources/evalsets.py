"""Evaluation inputs: question files per tier, plain line lists, per-question results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

# Columns of each tier's question file.
TIER_COLUMNS = {
    "tier1": ("question", "reference_sql", "expected_value"),
    "tier2": ("question", "source_id", "expected_claim"),
    "tier3": ("question", "reference_answer"),
}


def _content_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    return lines.where((strip("value") != "") & ~strip("value").startswith("#"))


def read_questions(spark: SparkSession, path: str, tier: str) -> DataFrame:
    """Questions of one tier, checked: header, field count, at least one row.

    Comment lines (``#``) and blank lines are skipped, the first line left must be the header,
    and there is no quoting. The checks read that line and one small aggregate over the file.
    """
    if tier not in TIER_COLUMNS:
        raise ValueError(f"unknown tier {tier!r}; expected one of {sorted(TIER_COLUMNS)}")
    names = TIER_COLUMNS[tier]
    fields = F.transform(F.split("value", "\t"), strip)
    lines = _content_lines(spark, path).select(fields.alias("f"))
    header = F.array(*[F.lit(n) for n in names])

    first = lines.first()
    if first is None or tuple(first["f"]) != names:
        raise ValueError(f"{path}: expected header {names}, got {first and first['f']}")
    check = lines.agg(
        F.count_if((F.col("f") != header) & (F.size("f") == len(names))).alias("rows"),
        F.count_if(F.size("f") != len(names)).alias("ragged"),
    ).first()
    if check["ragged"]:
        raise ValueError(f"{path}: {check['ragged']} line(s) without exactly {len(names)} columns")
    if check["rows"] == 0:
        raise ValueError(f"{path}: no questions after the header")

    rows = lines.where(F.col("f") != header)
    return rows.select(F.lit(tier).alias("tier"), *[F.col("f")[i].alias(n) for i, n in enumerate(names)])


def read_line_list(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed line per row, without comments and blanks."""
    return _content_lines(spark, path).select(strip("value").alias("question"))


RESULT_SCHEMA = (
    "tier string, question string, answer string, score double, passed boolean, pending boolean, "
    "latency_s double, n_tool_calls int, n_llm_calls int, stopped_reason string, "
    "metric_breakdown struct<cite_ok:boolean,judge_score:double,reason:string>"
)


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """Per-question result files, one JSON object each."""
    return spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(folder)
