"""Backlogs: what is still to do, and the append-only record of what was done."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip

TRACKER_SCHEMA = (
    "doc_id string, volume_path string, parsed_at timestamp, parser_version string, "
    "parse_status string, error_message string"
)


#: A budget up to this is picked by keeping the first rows of each task and then of those.
SMALL_BUDGET = 10_000


def first_rows(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``key``, in that order, none of them counted or held in one task.

    The rows are sorted over all tasks and written; a row's rank is its place in its part plus the sizes of the parts before.
    """
    from ..session import stage

    placed = stage(rows.orderBy(key).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = sizes.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    ranked = placed.join(F.broadcast(before), part == F.col("_part"))
    return ranked.where(F.col("_before") + place < n).select(*[placed[f"`{c}`"] for c in rows.columns]).orderBy(key)


def pending(docs: DataFrame, done: DataFrame, doc_id: str, done_id: str = "doc_id", budget: int | None = None) -> DataFrame:
    """Documents not yet recorded as done, in id order, at most ``budget`` of them per run.

    Of a budget above ``SMALL_BUDGET`` the ids still to do are written on the way (:func:`first_rows`).
    """
    seen = done.select(F.col(done_id).alias("_done"))
    left = docs.join(seen, F.col(doc_id) == F.col("_done"), "left_anti")
    if budget is not None and budget > SMALL_BUDGET:
        return first_rows(left, doc_id, budget)
    return left if budget is None else left.orderBy(doc_id).limit(budget)


def unscraped(cases: DataFrame, scraped: DataFrame, case_id: str, opened: str, since: str) -> DataFrame:
    """Distinct ids opened on or after ``since`` (compared as ``yyyyMMdd`` text) without documents."""
    wanted = cases.where(F.col(case_id).isNotNull() & (F.col(opened) >= since)).select(case_id).distinct()
    return wanted.join(scraped.select(F.col(case_id).alias("_seen")), F.col(case_id) == F.col("_seen"), "left_anti")


def track(
    work: DataFrame, text: Column, version: str, doc_id: str = "doc_id", path: str = "volume_path",
    details: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Parsed text, its ``details`` and its tracker columns side by side, one verdict per document.

    A document that is missing (``content`` NULL) or yields no text is recorded as an error, so
    it is not queued again and does not fail its neighbours.
    """
    parsed = work.withColumn("full_text", text)
    missing = F.col("content").isNull() if "content" in work.columns else F.lit(False)
    empty = F.coalesce(strip("full_text"), F.lit("")) == ""
    problem = F.when(missing, F.lit("document is missing")).when(empty, F.lit("document has no text"))
    return parsed.select(
        F.col(doc_id).alias("doc_id"),
        F.col(path).alias("volume_path"),
        "full_text",
        F.current_timestamp().alias("parsed_at"),
        F.lit(version).alias("parser_version"),
        F.when(problem.isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("parse_status"),
        problem.alias("error_message"),
        *[value.alias(name) for name, value in (details or {}).items()],
    )


def drain(
    spark: SparkSession,
    docs: DataFrame,
    load: Callable[[DataFrame], DataFrame],
    text: Callable[[DataFrame], Column],
    parsed_table: str,
    tracker_table: str,
    *,
    doc_id: str,
    path: str,
    version: str,
    budget: int = 200,
    details: Mapping[str, Column] | None = None,
) -> dict[str, int]:
    """One run over the backlog: pick, load, parse, append texts and tracker rows, tally.

    ``details`` are further columns of the parsed table, such as pages, document metadata or the
    parser's raw output, worked out from ``full_text`` and the loaded columns. The parsed batch is written to shared storage once; texts, tracker rows and tally all read
    that file, so nothing is parsed twice.
    """
    from ..session import stage

    if not spark.catalog.tableExists(tracker_table):
        spark.createDataFrame([], TRACKER_SCHEMA).write.saveAsTable(tracker_table)
    todo = pending(docs.select(doc_id, path), spark.table(tracker_table), doc_id, budget=budget)
    loaded = load(todo.select(F.col(doc_id).alias("doc_id"), F.col(path).alias("volume_path")))
    details = details or {}
    batch = stage(track(loaded, text(loaded), version, details=details), "parsed")

    ok = batch.where("parse_status = 'ok'")
    ok.select("doc_id", "volume_path", "full_text", "parsed_at", "parser_version", *details).write.mode("append").saveAsTable(
        parsed_table
    )
    batch.drop("full_text", *details).write.mode("append").saveAsTable(tracker_table)
    tally = batch.agg(F.count("*").alias("queued"), F.count_if(F.col("parse_status") == "ok").alias("ok")).first()
    return {"queued": tally["queued"], "parsed_ok": tally["ok"], "parsed_err": tally["queued"] - tally["ok"]}


def point_lookup(ids: DataFrame, table: DataFrame, key: str, columns: list[str], max_length: int = 64) -> DataFrame:
    """One row per asked id with ``found``, the columns of its first match, and ``reason``.

    Ids are taken as text; one longer than ``max_length`` is not looked up, and ``reason`` says so.
    """
    from .merge import one_per_key

    too_long = F.length(key) > max_length
    wanted = ids.select(F.col(key).cast("string").alias(key)).distinct()
    rows = table.select(F.col(key).cast("string").alias("_id"), *columns)
    short = wanted.where(~F.coalesce(too_long, F.lit(False)))
    rows = one_per_key(rows.join(short, F.col("_id") == F.col(key), "left_semi"), ["_id"], columns)
    return wanted.join(rows, F.col(key) == F.col("_id"), "left").select(
        key, F.col("_id").isNotNull().alias("found"), *columns, F.when(too_long, F.lit("id too long")).alias("reason")
    )
