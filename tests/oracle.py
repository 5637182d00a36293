"""Compare a Spark result with the DuckDB result of its check, as bags of rows."""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _kind(arrow_type) -> str:
    name = str(arrow_type)
    for prefix, kind in (
        ("large_string", "text"), ("string", "text"), ("bool", "bool"), ("double", "float"), ("float", "float"),
        ("timestamp", "time"), ("date", "date"), ("list", "list"), ("large_list", "list"), ("decimal", "decimal"),
    ):
        if name.startswith(prefix):
            return kind
    return "int" if "int" in name else name


def _bag(table, names):
    columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in names]
    return Counter(zip(*columns, strict=True)) if columns else Counter()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def differences(df, con, sql: str) -> list[str]:
    got = df.toArrow()
    want = con.sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"]
    names = sorted(got.column_names)
    problems = [
        f"type of {n}: {got.schema.field(n).type} vs {want.schema.field(n).type}"
        for n in names
        if _kind(got.schema.field(n).type) != _kind(want.schema.field(n).type)
        and str(want.schema.field(n).type) != "null"
    ]
    a, b = _bag(got, names), _bag(want, names)
    if a != b:
        problems.append(f"rows {got.num_rows} vs {want.num_rows}; columns {names}")
        problems.append(f"  only spark: {[str(r)[:400] for r in list((a - b))[:2]]}")
        problems.append(f"  only check: {[str(r)[:400] for r in list((b - a))[:2]]}")
    return problems


def main(folder: str, only: list[str]) -> int:
    root = Path(__file__).resolve().parents[1]
    sys.path.insert(0, str(root))
    import __spark_entry__ as entry
    from motorwatch.session import build_session

    if os.environ.get("PLAIN"):  # a session with nothing but Spark's own defaults
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
    spark = SparkSession.getActiveSession() or build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(folder), entry.oracle_sql(), 0
    folder = os.environ.get("SPARK_FOLDER", folder)  # the same tables, stored another way
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        try:
            if name in sql:
                problems = differences(run(spark, folder), con, sql[name])
            else:
                n = run(spark, folder).count()
                problems = [] if n else ["no rows"]
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:900]}"]
        bad += bool(problems)
        mark = "FAIL" if problems else ("ok" if name in sql else "rows")
        print(f"{mark:5} {name:28} {time.perf_counter() - start:6.2f}s", flush=True)
        for p in problems:
            print("      ", p[:1500], flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
