"""Idempotent ingestion: provenance, keep-one per key, insert-only merge."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import freed_shuffles, stage
from ..sources.feeds import PROVENANCE, Feed

#: Hashes of keys up to this number are broadcast to the rows.
BROADCAST_KEYS = 2_000_000
#: Raw rows repeat themselves, in columns and once more as JSON.
COMPRESSION = "zstd"


def stamp(
    df: DataFrame, run_id: str, source: str | Column, at: dt.datetime | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Add the provenance columns; the whole source row, or its ``columns``, is kept as JSON, NULLs included.

    One timestamp per call, fixed when the plan is made, so all rows of a run share it.
    """
    at = at or dt.datetime.now(tz=dt.UTC)
    columns = columns or df.columns
    return df.select(
        *[F.col(c) for c in df.columns],
        F.lit(run_id).alias("_ingest_run_id"),
        F.lit(at).alias("_ingested_at"),
        (F.lit(source) if isinstance(source, str) else source).alias("_source_url"),
        F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("_raw"),
    )


def one_per_key(
    df: DataFrame, key: Sequence[str], order: Sequence[str | Column] = (), keep: str = "first"
) -> DataFrame:
    """One row per key (NULL is a key value too): the first or last in ``order``.

    Written as row_number() = 1, which Spark turns into a group limit below the shuffle: every
    task sends at most one row per key, so a key holding a third of all rows costs no more than
    any other. Without an order, the remaining columns decide, to be repeatable.
    """
    by: list[Column] = [F.col(o) if isinstance(o, str) else o for o in order]
    by = by or [F.col(c) for c in df.columns if c not in key and not _is_map(df, c)]
    by = [c.desc() if keep == "last" else c.asc() for c in by] or [F.lit(1)]
    window = Window.partitionBy(*key).orderBy(*by)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def _is_map(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.MapType, T.VariantType))


def null_safe(pairs: Sequence[tuple[str, str]]) -> Column:
    """Equality that also matches NULL with NULL; still a hash-partitionable join condition.

    Names must be unique over both sides of the join.
    """
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


def new_rows(
    batch: DataFrame,
    target: DataFrame,
    key: Sequence[str],
    order: Sequence[str | Column] = (),
    keep: str = "first",
) -> DataFrame:
    """Rows of ``batch`` to insert: one per key, and only keys the target does not have.

    The batch is reduced to one row per key first, so the anti-join never meets a hot key. The
    target contributes its key columns only, and of these the batch's keys: where the batch is small
    next to the target, Spark broadcasts its keys and the target is read but not moved.
    """
    once = one_per_key(batch, key, order, keep)
    asked = batch.select(*[F.col(k).alias(f"_b_{k}") for k in key]).distinct()
    known = target.select(*[F.col(k).alias(f"_t_{k}") for k in key])
    known = known.join(asked, null_safe([(f"_t_{k}", f"_b_{k}") for k in key]), "left_semi")
    return once.join(known, null_safe([(k, f"_t_{k}") for k in key]), "left_anti")


def insert_only(
    target: DataFrame,
    batch: DataFrame,
    key: Sequence[str],
    order: Sequence[str | Column] = (),
    keep: str = "first",
) -> DataFrame:
    """Target after the merge: its own rows untouched, plus the new ones; columns may be added."""
    return target.unionByName(new_rows(batch, target, key, order, keep), allowMissingColumns=True)


_HASHED = (T.StringType, T.BinaryType, T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def _hashable(batch: DataFrame, target: DataFrame, key: Sequence[str]) -> bool:
    """Whether equal keys have equal hashes: one plain type on both sides, compared byte by byte."""
    kinds = [(batch.schema[k].dataType, target.schema[k].dataType) for k in key]
    plain = all(a == b and isinstance(a, _HASHED) for a, b in kinds)
    return plain and all(a == T.StringType() for a, _ in kinds if isinstance(a, T.StringType))


def _key_hash(key: Sequence[str], seed: int) -> Column:
    """64 bits of a key; hashing passes over NULL, so each value says as well whether it is one."""
    return F.xxhash64(F.lit(seed), *[part for k in key for part in (F.col(k), F.col(k).isNull())])


def _hashes(df: DataFrame, label: str) -> DataFrame:
    """Hashes written once, and broadcast where they are few."""
    stored = stage(df, label)
    return F.broadcast(stored) if stored.count() <= BROADCAST_KEYS else stored


def new_rows_by_hash(
    batch: DataFrame, target: DataFrame, key: Sequence[str], order: Sequence[str | Column] = (), keep: str = "first"
) -> DataFrame:
    """The rows of :func:`new_rows`, decided on hashes of the keys, so that whole rows mostly stay where they lie.

    For an empty target 64 bits per row are grouped: rows whose hash is theirs alone go as they are, the others, of
    equal keys or of equal hashes, are told apart by their keys. Otherwise 128 bits per row of both sides are grouped, and the rows
    whose hash the target lacks are looked at; the target moves nothing else. ``batch`` is read more than once and should lie in files.
    """
    if target.isEmpty():
        found = batch.groupBy(_key_hash(key, 0).alias("_h")).agg(F.count("*").alias("_n"))
        shared = _hashes(found.where("_n > 1").select("_h"), "shared-keys")
        rows, same = batch.withColumn("_k", _key_hash(key, 0)), F.col("_k") == F.col("_h")
        alone = rows.join(shared, same, "left_anti").drop("_k")
        return alone.unionByName(one_per_key(rows.join(shared, same, "left_semi").drop("_k"), key, order, keep))
    a, b = _key_hash(key, 0), _key_hash(key, 1)
    sides = [df.select(a.alias("_h"), b.alias("_i"), F.lit(side).alias("_side")) for df, side in ((batch, 1), (target, 2))]
    found = sides[0].unionAll(sides[1]).groupBy("_h", "_i").agg(F.bit_or("_side").alias("_side"))
    unknown = _hashes(found.where("_side = 1").select("_h", "_i"), "new-keys")
    rows = batch.withColumns({"_k": a, "_l": b})
    rows = rows.join(unknown, (F.col("_k") == F.col("_h")) & (F.col("_l") == F.col("_i")), "left_semi")
    return one_per_key(rows, ["_k", "_l", *key], order, keep).drop("_k", "_l")


def create_if_missing(spark: SparkSession, table: str, schema: T.StructType) -> bool:
    """Create an empty table; tells whether it was missing."""
    if spark.catalog.tableExists(table):
        return False
    spark.createDataFrame([], schema).write.format("parquet").option("compression", COMPRESSION).saveAsTable(table)
    return True


def add_missing_columns(spark: SparkSession, table: str, schema: T.StructType) -> list[str]:
    """Widen a table by the columns it lacks; none is ever dropped, renamed or retyped."""
    have = {name.lower() for name in spark.table(table).columns}
    extra = [f for f in schema.fields if f.name.lower() not in have]
    if extra:
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({ddl})")
    return [f.name for f in extra]


def merge_into_table(
    spark: SparkSession,
    table: str,
    batch: DataFrame,
    key: Sequence[str],
    order: Sequence[str | Column] = (),
    keep: str = "first",
    finish: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> None:
    """Append the rows of ``batch`` whose key is new. Running it twice changes nothing.

    ``finish`` turns the rows that were chosen into those of the table, so that columns which have no part in the choice are
    made for these rows alone. Parquet has no transactions, so one writer per table: the caller serialises its batches.
    """
    schema = finish(batch).schema
    create_if_missing(spark, table, schema)
    add_missing_columns(spark, table, schema)
    target = spark.table(table)
    choose = new_rows_by_hash if _hashable(batch, target, key) else new_rows
    with freed_shuffles(spark):
        fresh = finish(choose(batch, target, key, order, keep))
        missing = [f for f in target.schema.fields if f.name not in fresh.columns]
        fresh = fresh.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
        fresh.select(*target.columns).write.mode("append").format("parquet").saveAsTable(table)


def ingest(
    spark: SparkSession, feed: Feed, rows: DataFrame, schema: str, run_id: str, source: str
) -> None:
    """Land one feed in its raw table: fixed columns, provenance, insert-only merge.

    The provenance JSON is taken before the columns are cut to the feed's layout, so overflow
    fields survive in ``_raw``. Feeds without a fixed layout keep the columns they came with.
    """
    columns = list(feed.columns) or [c for c in rows.columns if c not in PROVENANCE.names]
    at = dt.datetime.now(tz=dt.UTC)
    absent = [c for c in columns if c not in rows.columns]
    batch = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in absent])
    order = ["_sgo_source"] if feed.keep == "last" and "_sgo_source" in rows.columns else []
    tie_break = [*order, *[c for c in columns if c not in feed.key and c not in order]]
    merge_into_table(
        spark,
        f"{schema}.{feed.table}",
        batch,
        feed.key,
        tie_break,
        feed.keep,
        lambda chosen: stamp(chosen, run_id, source, at, rows.columns).select(*columns, *PROVENANCE.names),
    )
