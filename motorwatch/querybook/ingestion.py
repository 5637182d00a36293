"""Scans, merges, provenance, snapshots."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions.text import header_name, header_name_col
from ..operators import bucketed, catalog, changelog, merge, snapshot
from ..session import scratch_path
from ..sources.flat_files import read_csv_snapshots, read_flat
from ..streaming.ingest import BATCH, ingest_available, ingest_new_keys, read_landed
from . import feeds
from .registry import Tables, query

_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
_CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _typed_customer(df):
    return df.select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"),
        "c_name",
        F.col("c_nationkey").cast("int").alias("c_nationkey"),
        F.col("c_acctbal").cast("double").alias("c_acctbal"),
        "c_mktsegment",
    )


@query("scan_flat_tsv", _CUSTOMER_SQL)
def scan_flat_tsv(t: Tables):
    path = scratch_path(t.spark, "flat")
    t.customer.select(*_CUSTOMER).write.csv(path, sep="\t", quote='"', escape='"')
    return _typed_customer(read_flat(t.spark, path, _CUSTOMER, encoding="UTF-8"))


@query(
    "scan_flat_overflow",
    "SELECT c_custkey, c_name, c_nationkey, c_mktsegment AS extra FROM customer",
)
def scan_flat_overflow(t: Tables):
    """Read with fewer columns than the file has: the rest arrives in the overflow array."""
    path = scratch_path(t.spark, "overflow")
    t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").write.csv(path, sep="\t", quote='"', escape='"')
    rows = read_flat(t.spark, path, _CUSTOMER[:3], encoding="UTF-8", overflow=True)
    return rows.select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"),
        "c_name",
        F.col("c_nationkey").cast("int").alias("c_nationkey"),
        F.try_element_at("_overflow", F.lit(1)).alias("extra"),
    )


_NARRATIVES_SQL = "SELECT doc_id, lang, md5(text) AS body, length(text) - length(replace(text, chr(10), '')) AS n_breaks FROM documents"


def _narratives(df, text: str):
    return df.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.md5(text).alias("body"), F.regexp_count(text, F.lit("\n")).cast("bigint").alias("n_breaks")
    )


@query("scan_quoted_tsv", _NARRATIVES_SQL)
def scan_quoted_tsv(t: Tables):
    """A headerless feed whose narratives hold line breaks, quotes and tabs inside quotes."""
    path = scratch_path(t.spark, "narratives")
    rows = t.documents.select("doc_id", "text", "lang")
    rows.write.csv(path, sep="\t", quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return _narratives(read_flat(t.spark, path, ("doc_id", "text", "lang"), encoding="UTF-8"), "text")


@query("scan_quoted_snapshots", _NARRATIVES_SQL)
def scan_quoted_snapshots(t: Tables):
    """Header CSVs of two layouts, one per half of the languages, whose narratives hold line breaks."""
    paths = [scratch_path(t.spark, name) for name in ("early", "late")]
    early = F.coalesce(F.col("lang").isin("en", "de"), F.lit(False))
    columns = {"Report ID": "doc_id", "Narrative / (Text)": "text", "Lang": "lang", "Source?": "source"}
    for path, kept, names in ((paths[0], early, ("Report ID", "Narrative / (Text)", "Lang")), (paths[1], ~early, ("Source?", "Lang", "Report ID", "Narrative / (Text)"))):
        rows = t.documents.where(kept).select(*[F.col(columns[n]).alias(n) for n in names])
        rows.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = read_csv_snapshots(t.spark, paths)
    return _narratives(rows.withColumnRenamed("report_id", "doc_id"), "narrative_text")


@query(
    "scan_multi_file",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate::DATE AS o_orderdate, o_orderpriority FROM orders",
)
def scan_multi_file(t: Tables):
    """One folder per five-year window, read back as one feed."""
    columns = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    orders = t.orders.select(*columns[:3], F.col("o_orderdate").cast("date").alias("o_orderdate"), columns[4])
    windows = (("1990", "1995"), ("1995", "2000"), ("2000", None))
    paths = []
    for start, stop in windows:
        part = orders.where(F.year("o_orderdate") >= int(start)) if stop else orders.where(
            F.coalesce(F.year("o_orderdate") >= int(start), F.lit(True))
        )
        part = part.where(F.year("o_orderdate") < int(stop)) if stop else part
        paths.append(scratch_path(t.spark, f"window-{start}"))
        part.write.csv(paths[-1], sep="\t", quote='"', escape='"')
    rows = read_flat(t.spark, paths, columns, encoding="UTF-8")
    return rows.select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
        F.col("o_custkey").cast("bigint").alias("o_custkey"),
        "o_orderstatus",
        F.col("o_orderdate").cast("date").alias("o_orderdate"),
        "o_orderpriority",
    )


@query(
    "scan_csv_headers_union",
    """SELECT event_id AS report_id, event_type AS crash_with, user_id AS operator_entity_no, NULL::VARCHAR AS weather
       FROM events WHERE event_type IN ('view', 'click')
       UNION ALL BY NAME
       SELECT event_id AS report_id, event_type AS crash_with, NULL::BIGINT AS operator_entity_no, props AS weather
       FROM events WHERE event_type NOT IN ('view', 'click')""",
)
def scan_csv_headers_union(t: Tables):
    """Two snapshots with different headers; between them they hold every event."""
    first, second = scratch_path(t.spark, "ads"), scratch_path(t.spark, "adas")
    early = F.col("event_type").isin("view", "click")
    t.events.where(early).select(
        F.col("event_id").alias("Report ID"),
        F.col("event_type").alias("Crash With?"),
        F.col("user_id").alias("Operator / Entity (No.)"),
    ).write.csv(first, header=True, quote='"', escape='"')
    t.events.where(~early).select(
        F.col("event_id").alias("Report-ID"), F.col("event_type").alias("CRASH  WITH"), F.col("props").alias("Weather")
    ).write.csv(second, header=True, quote='"', escape='"')
    rows = read_csv_snapshots(t.spark, [first, second])
    return rows.select(
        F.col("report_id").cast("bigint").alias("report_id"),
        "crash_with",
        F.col("operator_entity_no").cast("bigint").alias("operator_entity_no"),
        "weather",
    )


@query(
    "normalize_header",
    """SELECT DISTINCT p_name, trim(regexp_replace(lower(p_brand || ' / (' || p_type || ')__' || p_name || '?'), '[^0-9a-z]+', '_', 'g'), '_') AS header
       FROM part""",
)
def normalize_header(t: Tables):
    raw = F.concat("p_brand", F.lit(" / ("), "p_type", F.lit(")__"), "p_name", F.lit("?"))
    assert header_name("Brand#1 / (X)__y?") == "brand_1_x_y"
    return t.part.select("p_name", header_name_col(raw).alias("header")).distinct()


@query(
    "insert_only_merge",
    """WITH target AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_shipdate < DATE '1999-01-01' GROUP BY ALL),
       fresh AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)
       SELECT * FROM target UNION ALL
       SELECT f.* FROM fresh f ANTI JOIN target t ON f.l_orderkey = t.l_orderkey AND f.l_linenumber = t.l_linenumber""",
)
def insert_only_merge(t: Tables):
    """Lines shipped so far, merged with a full reload: known keys stay, new ones enter once."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
    key = ["l_orderkey", "l_linenumber"]
    shipped = t.lineitem.where(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")).groupBy(*key)
    return merge.insert_only(shipped.agg(F.min("l_suppkey").alias("l_suppkey")), lines, key, ["l_suppkey"])


@query(
    "bucketed_merge",
    """WITH target AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_shipdate < DATE '1999-01-01' GROUP BY ALL),
       fresh AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)
       SELECT * FROM target UNION ALL
       SELECT f.* FROM fresh f ANTI JOIN target t ON f.l_orderkey = t.l_orderkey AND f.l_linenumber = t.l_linenumber""",
)
def bucketed_merge(t: Tables):
    """The same merge into a target bucketed by its key, run twice: the target is not moved, the second run adds nothing."""
    lines, key = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), ["l_orderkey", "l_linenumber"]
    schema = f"bucketed_{uuid.uuid4().hex[:12]}"
    t.spark.sql(f"CREATE DATABASE {schema}")
    table = f"{schema}.shipped"
    bucketed.create_bucketed(t.spark, table, lines.schema, key, 16)
    bucketed.merge_into_buckets(t.spark, table, t.lineitem.where(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")).select(*lines.columns), ["l_suppkey"])
    for _ in range(2):
        bucketed.merge_into_buckets(t.spark, table, lines, ["l_suppkey"])
    return t.spark.table(table)


@query("stateful_ingest", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def stateful_ingest(t: Tables):
    """Files streamed in by keys that the stream remembers, then the same files again under another name: nothing is added, the target is never read."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus"]
    source, target, progress = (scratch_path(t.spark, n) for n in ("arriving", "landed-keys", "key-progress"))
    schema = t.orders.select(*columns).schema
    for _ in range(2):
        t.orders.select(*columns).write.mode("append").parquet(source)
        ingest_new_keys(t.spark, t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source), ["o_orderkey"], target, progress)
    return read_landed(t.spark, target, schema).drop(BATCH)


@query(
    "dedupe_first",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn FROM lineitem)
       WHERE rn = 1""",
)
def dedupe_first(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return merge.one_per_key(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query(
    "dedupe_last",
    """SELECT user_id, event_type, event_id FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
       WHERE rn = 1""",
)
def dedupe_last(t: Tables):
    """Last write wins, as for cumulative crash snapshots."""
    rows = merge.one_per_key(t.events, ["user_id", "event_type"], ["ts", "event_id"], keep="last")
    return rows.select("user_id", "event_type", "event_id")


@query(
    "schema_evolution",
    """SELECT c_custkey, c_name, NULL::VARCHAR AS c_mktsegment FROM customer
       UNION ALL SELECT -1 - c_custkey, c_name, c_mktsegment FROM customer""",
)
def schema_evolution(t: Tables):
    """A batch with one more column than the target: old rows get NULL for it."""
    target = t.customer.select("c_custkey", "c_name")
    again = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    new = t.customer.select((-1 - F.col("c_custkey")).alias("c_custkey"), "c_name", "c_mktsegment")
    return merge.insert_only(target, again.unionByName(new), ["c_custkey"])


@query(
    "provenance",
    """SELECT s_suppkey, 'run-1' AS _ingest_run_id, 'feed://supplier' AS _source_url,
         '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","note":null}' AS _raw FROM supplier""",
)
def provenance(t: Tables):
    rows = t.supplier.select("s_suppkey", "s_name", F.lit(None).cast("string").alias("note"))
    stamped = merge.stamp(rows, "run-1", "feed://supplier", dt.datetime(2024, 1, 1, tzinfo=dt.UTC))
    return stamped.select("s_suppkey", "_ingest_run_id", "_source_url", "_raw")


@query(
    "incremental_ingest",
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
)
def incremental_ingest(t: Tables):
    """Stream the files in, then again from scratch: the second run adds nothing.

    The path is a pattern, as a file stream takes folders or patterns but no single file.
    """
    columns = ["o_orderkey", "o_custkey", "o_orderstatus"]
    target = scratch_path(t.spark, "landed")
    schema = t.orders.select(*columns).schema
    for attempt in (1, 2):
        files = t.spark.readStream.schema(t.orders.schema).option("maxFilesPerTrigger", 64).parquet(t.path("orders") + "*")
        ingest_available(
            t.spark, files.select(*columns), ["o_orderkey"], target, scratch_path(t.spark, f"progress-{attempt}"),
            order=["o_custkey", "o_orderstatus"],
        )
    return read_landed(t.spark, target, schema).drop(BATCH)


@query(
    "partition_pruned_read",
    """SELECT o_orderkey, o_totalprice, year(o_orderdate)::INTEGER AS order_year FROM orders
       WHERE year(o_orderdate) BETWEEN 1997 AND 1998""",
)
def partition_pruned_read(t: Tables):
    path = scratch_path(t.spark, "by-year")
    rows = t.orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("order_year"))
    catalog.write_partitioned(rows, path, "order_year")
    return t.spark.read.parquet(path).where("order_year BETWEEN 1997 AND 1998")


_V2_KEPT = "o_orderpriority <> '4-NOT SPECIFIED'"


@query(
    "snapshot_diff",
    f"""WITH v1 AS (SELECT o_orderkey, o_orderstatus, o_custkey FROM orders),
       v2 AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey
              FROM orders WHERE {_V2_KEPT} UNION ALL SELECT -1 - o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
       SELECT coalesce(v1.o_orderkey, v2.o_orderkey) AS o_orderkey,
         CASE WHEN v1.o_orderkey IS NULL THEN 'insert' WHEN v2.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS change
       FROM v1 FULL JOIN v2 ON v1.o_orderkey = v2.o_orderkey
       WHERE v1.o_orderkey IS NULL OR v2.o_orderkey IS NULL OR v1.o_orderstatus <> v2.o_orderstatus""",
)
def snapshot_diff(t: Tables):
    """Orders against a later version in which some rows are gone, some changed, some new."""
    before, after = _versions(t)
    return snapshot.diff(before, after, "o_orderkey", ["o_orderstatus", "o_custkey"])


@query(
    "incremental_index",
    f"""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey
        FROM orders WHERE {_V2_KEPT} UNION ALL SELECT -1 - o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderpriority = '5-LOW'""",
)
def incremental_index(t: Tables):
    """An index brought up to date from the changes alone equals a full rebuild."""
    before, after = _versions(t)
    changes = snapshot.diff(before, after, "o_orderkey", ["o_orderstatus", "o_custkey"])
    return snapshot.apply_changes(before, changes, after, "o_orderkey")


_V2_SQL = f"""v2 AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders WHERE {_V2_KEPT}
       UNION ALL SELECT -1 - o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderpriority = '5-LOW')"""


def _logged_orders(t: Tables) -> str:
    """A log of three versions: all orders, a later version by comparison, and a batch of upserts and removals."""
    log = scratch_path(t.spark, "order-log")
    before, after = _versions(t)
    changelog.commit(before.withColumn(changelog.CHANGE, F.lit("insert")), log, ["o_orderkey"])
    changelog.commit(changelog.changes_between(before, after, "o_orderkey", ["o_orderstatus", "o_custkey"]), log, ["o_orderkey"])
    third = before.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("Z"))
    changelog.commit(changelog.upserts(after, third, ["o_orderkey"], after.where("o_orderkey < 0")), log, ["o_orderkey"])
    return log


@query(
    "change_log_index",
    f"""WITH {_V2_SQL}
        SELECT o_orderkey, 'Z' AS o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL SELECT o_orderkey, o_orderstatus, o_custkey FROM v2 WHERE o_orderkey % 3 <> 0 AND o_orderkey >= 0""",
)
def change_log_index(t: Tables):
    """A table that follows the log: read as a stream, in two steps, then again, and folded; it equals the newest version."""
    log, table, checkpoint = _logged_orders(t), scratch_path(t.spark, "order-index"), scratch_path(t.spark, "order-progress")
    schema = t.orders.select("o_orderkey", "o_orderstatus", "o_custkey").schema

    def follow() -> int:
        return changelog.follow(t.spark, log, table, checkpoint, schema, ["o_orderkey"], files_per_batch=16)

    follow()
    if follow():
        raise AssertionError("changes were read twice")
    changelog.fold(t.spark, table, ["o_orderkey"])
    return changelog.read_following(t.spark, table, ["o_orderkey"])


@query(
    "change_log_versions",
    f"""WITH {_V2_SQL}, d AS (SELECT o.o_orderkey IS NULL AS fresh, v2.o_orderkey IS NULL AS gone
          FROM orders o FULL JOIN v2 ON o.o_orderkey = v2.o_orderkey
          WHERE o.o_orderkey IS NULL OR v2.o_orderkey IS NULL OR o.o_orderstatus <> v2.o_orderstatus)
        SELECT 1 AS version, 'insert' AS change, count(*) AS n_changes FROM orders
        UNION ALL SELECT 2, CASE WHEN fresh THEN 'insert' WHEN gone THEN 'delete' ELSE 'update' END, count(*) FROM d GROUP BY ALL
        UNION ALL SELECT 3, CASE WHEN v2.o_orderkey IS NULL THEN 'insert' ELSE 'update' END, count(*) FROM orders o LEFT JOIN v2 ON o.o_orderkey = v2.o_orderkey
          WHERE o.o_orderkey % 3 = 0 GROUP BY ALL
        UNION ALL SELECT 3, 'delete', count(*) FROM v2 WHERE o_orderkey < 0""",
)
def change_log_versions(t: Tables):
    """What each version of the log changed."""
    schema = t.orders.select("o_orderkey", "o_orderstatus", "o_custkey").schema
    rows = changelog.read_log(t.spark, _logged_orders(t), schema)
    return rows.groupBy(F.col(changelog.VERSION).alias("version"), F.col(changelog.CHANGE).alias("change")).agg(F.count("*").alias("n_changes"))


def _versions(t: Tables):
    columns = ("o_orderkey", "o_orderstatus", "o_custkey")
    status = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("X")).otherwise(F.col("o_orderstatus"))
    kept = t.orders.where(_V2_KEPT).select("o_orderkey", status.alias("o_orderstatus"), "o_custkey")
    new = t.orders.where("o_orderpriority = '5-LOW'").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), *columns[1:])
    return t.orders.select(*columns), kept.unionByName(new)


@query(
    "row_counts",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}"
        for n in ("orders", "lineitem", "part", "documents", "events", "pages", "conversations", "embeddings")
    ),
)
def row_counts(t: Tables):
    names = ("orders", "lineitem", "part", "documents", "events", "pages", "conversations", "embeddings")
    return catalog.row_counts({n: getattr(t, n) for n in names})


@query(
    "keyless_rows_merge",
    f"""SELECT compname, odate FROM (WITH {feeds.SQL_RAW_RECALLS} SELECT compname, odate FROM (SELECT compname, odate,
          row_number() OVER (PARTITION BY compname ORDER BY odate NULLS FIRST) AS n FROM raw_recalls) WHERE n = 1)""",
)
def keyless_rows_merge(t: Tables):
    """NULL is one key among others: merged twice, its row enters once."""
    rows = feeds.raw_recalls(t).select("compname", "odate")
    first = merge.one_per_key(rows, ["compname"], ["odate"])
    return merge.insert_only(first, rows, ["compname"], ["odate"])

