"""Star schema: dimensions, facts, calendar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import EARLIEST
from ..functions.keys import component_id, oem_group_id, vehicle_key


def _stack(frames: list[DataFrame], columns: dict[str, str]) -> DataFrame:
    """Same-named projections of several tables, one under the other.

    ``columns`` maps a name to its SQL type and folds missing text to ''.
    """
    picked = []
    for df in frames:
        picked.append(
            df.select(
                *[
                    (F.coalesce(F.col(n), F.lit("")) if t == "string" else F.col(n)).cast(t).alias(n)
                    for n, t in columns.items()
                ]
            ).distinct()
        )
    return reduce(lambda a, b: a.unionByName(b), picked).distinct()


def with_vehicle(df: DataFrame) -> DataFrame:
    """Typed tables in the columns of the vehicle key, as the facts see them.

    Investigations have their make under another name; crash reports may lack model and year.
    """
    if "make_norm" not in df.columns and "mfr_norm" in df.columns:
        df = df.withColumnRenamed("mfr_norm", "make_norm")
    absent = {c: F.lit(None).cast(t) for c, t in (("model_norm", "string"), ("model_year", "int")) if c not in df.columns}
    return df.withColumns(absent) if absent else df


def dim_vehicle(*typed: DataFrame) -> DataFrame:
    """One row per (make, model, year). Missing text is '' here, so each key occurs once."""
    rows = _stack([with_vehicle(df) for df in typed], {"make_norm": "string", "model_norm": "string", "model_year": "int"})
    return rows.withColumn("vehicle_key", vehicle_key())


def with_leaf(df: DataFrame) -> DataFrame:
    """Tables without a leaf column use their raw component as the leaf."""
    return df if "component_leaf" in df.columns else df.withColumn("component_leaf", F.col("component_raw"))


def dim_component(*typed: DataFrame) -> DataFrame:
    """One row per (group, leaf)."""
    rows = _stack([with_leaf(df) for df in typed], {"component_group": "string", "component_leaf": "string"})
    return rows.withColumn("component_id", component_id())


def dim_oem_group(*typed: DataFrame) -> DataFrame:
    """One row per group, and one without a name for makes outside the taxonomy."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.select("oem_group").distinct() for df in typed]).distinct()
    return rows.withColumn("oem_group_id", oem_group_id())


def date_bounds(dates: list[tuple[DataFrame, str]], as_of: Column | None = None) -> DataFrame:
    """One row ``(d_min, d_max)``: the floor is 1950, the end at least ``as_of``."""
    today = F.current_date() if as_of is None else as_of
    per_table = [df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")) for df, c in dates]
    both = reduce(lambda a, b: a.union(b), per_table).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    start = F.coalesce(F.col("lo"), F.add_months(today, -360))
    return both.select(
        F.greatest(start, F.lit(EARLIEST).cast("date")).alias("d_min"),
        F.greatest(F.col("hi"), today).alias("d_max"),
    )


def dim_date(bounds: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row per day between the bounds."""
    today = F.current_date() if as_of is None else as_of
    days = bounds.select(F.explode(F.sequence("d_min", "d_max")).alias("date_key"))
    return days.select(
        "date_key",
        F.year("date_key").alias("year"),
        F.quarter("date_key").alias("quarter"),
        F.month("date_key").alias("month"),
        F.day("date_key").alias("day"),
        F.date_format("date_key", "EEE").alias("day_of_week"),
        (F.col("date_key") == today).alias("is_today"),
    )


def _with_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"vehicle_key": vehicle_key(), "component_id": component_id(), "oem_group_id": oem_group_id()})


_KEYS = ("vehicle_key", "component_id", "oem_group_id")


def recalls_fact(typed: DataFrame) -> DataFrame:
    """One row per (campaign, vehicle, component); ``units_affected`` repeats within a campaign."""
    return _with_keys(typed).select(
        "record_id", "campaign_number", *_KEYS, "units_affected",
        F.col("owner_notify_date").alias("event_date"), "recall_type_code", "fmvss",
    )


def complaints_fact(typed: DataFrame) -> DataFrame:
    return _with_keys(typed).select(
        "complaint_id", "odi_number", *_KEYS, F.col("incident_date").alias("event_date"),
        "crash", "fire", "injured", "deaths", "miles", "state", "complaint_source",
    )


def bulletins_fact(typed: DataFrame) -> DataFrame:
    return _with_keys(with_leaf(typed)).select(
        "tsb_id", "nhtsa_item_number", "replacement_bulletin_no", *_KEYS,
        F.col("original_date").alias("event_date"), "communication_type", "mfr_component_system",
        "mfr_component_subsystem", "bulletin_year",
    )


def investigations_fact(typed: DataFrame) -> DataFrame:
    """One row per (investigation, vehicle).

    The leaf is the raw component, as in the component dimension, and model and year stay, so
    that all three keys meet their dimensions.
    """
    src = with_leaf(with_vehicle(typed))
    return _with_keys(src).select(
        "nhtsa_action_number", "investigation_type", "status", "days_open", *_KEYS,
        F.col("open_date").alias("event_date"), "close_date",
    )


# Outcome and context columns kept when a crash snapshot has them.
CRASH_CONTEXT = (
    "crash_with", "highest_injury_severity_alleged", "serious_injuries", "fatalities", "narrative", "city",
    "state", "country", "roadway_type", "roadway_surface", "lighting", "weather", "posted_speed_limit_mph",
)


def av_crashes_fact(typed: DataFrame) -> DataFrame:
    """Crash reports; no component key, as these are system events and not part failures."""
    have = set(typed.columns)
    src = with_vehicle(typed)
    source = [F.col("_sgo_source").alias("sgo_source")] if "_sgo_source" in have else []
    return src.withColumns({"vehicle_key": vehicle_key(), "oem_group_id": oem_group_id()}).select(
        "report_id", "vehicle_key", "oem_group_id", F.col("incident_date_d").alias("event_date"), "sae_level",
        *source, *[c for c in CRASH_CONTEXT if c in have],
    )


def calendar(spark: SparkSession, dates: list[tuple[DataFrame, str]], as_of: Column | None = None) -> DataFrame:
    return dim_date(date_bounds(dates, as_of), as_of)
