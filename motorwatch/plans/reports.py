"""Reports over the star schema.

Facts are reduced to one row per surrogate key before they meet a dimension: the join then
carries groups instead of rows, and a key holding most of the rows is already one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def since_days(as_of: Column, days: int, date: str = "event_date") -> Column:
    return F.col(date) >= F.date_sub(as_of, days)


def since_months(as_of: Column, months: int, date: str = "event_date") -> Column:
    return F.col(date) >= F.add_months(as_of, -months)


def in_year(year: Column, date: str = "event_date") -> Column:
    """The whole calendar year as a range, which reaches the file scan (``year(d) = y`` does not)."""
    return (F.col(date) >= F.make_date(year, F.lit(1), F.lit(1))) & (
        F.col(date) < F.make_date(year + 1, F.lit(1), F.lit(1))
    )


def is_open(closed: str = "close_date", status: str = "status") -> Column:
    return F.col(closed).isNull() | (F.upper(F.col(status)) == "OPEN")


def distinct_total(df: DataFrame, what: str, name: str) -> DataFrame:
    return df.agg(F.countDistinct(what).alias(name))


def deduplicated_sum(df: DataFrame, entity: str, measure: str, name: str) -> DataFrame:
    """Sum of a measure that is repeated on every row of its entity: each (entity, value) once."""
    once = df.select(entity, measure).distinct()
    return once.agg(F.coalesce(F.sum(measure), F.lit(0)).alias(name))


def labelled(
    grouped: DataFrame, dim: DataFrame, key: str, label: str, how: str = "inner"
) -> DataFrame:
    """Swap a surrogate key for its label."""
    return grouped.join(dim.select(key, label), key, how)


def top_by_distinct(
    fact: DataFrame, dim: DataFrame, key: str, label: str, entity: str, name: str, k: int | None = 10
) -> DataFrame:
    """Labels with the most distinct entities; rows without a label are left out."""
    pairs = labelled(fact.select(key, entity).distinct(), dim.where(F.col(label).isNotNull()), key, label)
    out = pairs.groupBy(label).agg(F.countDistinct(entity).alias(name))
    return out if k is None else out.orderBy(F.col(name).desc(), F.col(label).asc()).limit(k)


def top_by_count(
    fact: DataFrame, dim: DataFrame, key: str, label: str, name: str, k: int | None = 10
) -> DataFrame:
    per_key = fact.groupBy(key).agg(F.count("*").alias("_n"))
    out = labelled(per_key, dim.where(F.col(label).isNotNull()), key, label)
    out = out.groupBy(label).agg(F.sum("_n").alias(name))
    return out if k is None else out.orderBy(F.col(name).desc(), F.col(label).asc()).limit(k)


def top_by_sum(
    fact: DataFrame, dim: DataFrame, key: str, label: str, measure: str, name: str, k: int | None = 10
) -> DataFrame:
    """Plain sum over fact rows, repeats included."""
    per_key = fact.groupBy(key).agg(F.sum(measure).alias("_m"))
    out = labelled(per_key, dim, key, label).groupBy(label).agg(F.sum("_m").alias(name))
    return out if k is None else out.orderBy(F.col(name).desc_nulls_last(), F.col(label).asc()).limit(k)


def monthly_distinct(fact: DataFrame, entity: str, name: str, date: str = "event_date") -> DataFrame:
    month = F.trunc(F.col(date), "month").alias("month")
    return fact.select(month, entity).groupBy("month").agg(F.countDistinct(entity).alias(name)).orderBy("month")


def sum_by_make_and_year(fact: DataFrame, dim_vehicle: DataFrame, measure: str, name: str) -> DataFrame:
    per_key = fact.groupBy("vehicle_key", F.year("event_date").alias("yr")).agg(F.sum(measure).alias("_m"))
    out = labelled(per_key, dim_vehicle, "vehicle_key", "make_norm")
    return out.groupBy("make_norm", "yr").agg(F.sum("_m").alias(name)).orderBy(
        F.col("yr").desc(), F.col(name).desc(), "make_norm"
    )


def campaigns_for(fact: DataFrame, dim_vehicle: DataFrame, make: str, year: int) -> DataFrame:
    """Distinct campaigns of one make in one year."""
    keys = dim_vehicle.where(F.col("make_norm") == make).select("vehicle_key")
    rows = fact.where(in_year(F.lit(year))).select("vehicle_key", "campaign_number").distinct()
    return rows.join(keys, "vehicle_key", "left_semi").agg(F.countDistinct("campaign_number").alias("n_campaigns"))


def campaigns_by_make_and_year(fact: DataFrame, dim_vehicle: DataFrame) -> DataFrame:
    """Distinct campaigns per make and year; counting them removes repeats before its own shuffle."""
    rows = fact.select("vehicle_key", F.year("event_date").alias("yr"), "campaign_number")
    out = labelled(rows, dim_vehicle, "vehicle_key", "make_norm")
    return out.groupBy("make_norm", "yr").agg(F.countDistinct("campaign_number").alias("n_campaigns"))


def active_cases(fact: DataFrame, groups: DataFrame, components: DataFrame, k: int = 50) -> DataFrame:
    """Open investigations, newest first, each (case, component) once.

    Each case gives a row at least, so the ``k`` newest cases hold the ``k`` first rows: labels are
    looked up for these only.
    """
    columns = ("nhtsa_action_number", "investigation_type", "status", "days_open", "event_date")
    unlabelled = fact.where(is_open()).select(*columns, "oem_group_id", "component_id")
    newest = unlabelled.select(F.col("event_date").alias("_opened"), F.col("nhtsa_action_number").alias("_case")).distinct()
    newest = newest.orderBy(F.col("_opened").desc_nulls_last(), "_case").limit(k)
    same = F.col("event_date").eqNullSafe(F.col("_opened")) & F.col("nhtsa_action_number").eqNullSafe(F.col("_case"))
    once = unlabelled.join(newest, same, "left_semi").distinct()
    out = labelled(once, groups, "oem_group_id", "oem_group", "left")
    out = labelled(out, components, "component_id", "component_group", "left")
    out = out.select(
        F.col("nhtsa_action_number").alias("action_number"),
        F.col("investigation_type").alias("type"),
        "status",
        "days_open",
        F.col("oem_group").alias("oem"),
        F.col("component_group").alias("component"),
        F.col("event_date").alias("opened"),
    ).distinct()
    return out.orderBy(F.col("opened").desc_nulls_last(), "action_number", "component", "oem").limit(k)


def profile(df: DataFrame, metrics: Mapping[str, Column], by: tuple[str | Column, ...] = ()) -> DataFrame:
    """Several aggregates over a table or its groups in one pass."""
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in metrics.items()])


def profile_levels(df: DataFrame, metrics: Mapping[str, Column], levels: Sequence[Sequence[str]]) -> DataFrame:
    """The aggregates at several levels in one pass: the total is ``()``, a group ``("a",)``, a pair ``("a", "b")``.

    ``level`` tells the levels apart by their columns' names, comma-joined, as a column that is not grouped by is NULL like a group of
    NULLs. Rows are read and shuffled once; each is combined per level before the shuffle.
    """
    by = list(dict.fromkeys(c for level in levels for c in level))
    grouped = [F.when(F.grouping(c) == 0, F.lit(c)) for c in by]
    name = F.concat_ws(",", *grouped).alias("level") if by else F.lit("").alias("level")
    if not by:
        return df.agg(name, *[c.alias(n) for n, c in metrics.items()])
    sets = df.groupingSets([[F.col(c) for c in level] for level in levels], *by)
    return sets.agg(name, *[c.alias(n) for n, c in metrics.items()])


def keyword_test(text: str, all_of: tuple[str, ...] = (), any_of: tuple[str, ...] = ()) -> Column:
    """All of some words and any of others occur in a text, whatever the case."""
    low = F.lower(F.col(text))
    test = F.lit(True)
    for word in all_of:
        test = test & F.contains(low, F.lit(word.lower()))
    if any_of:
        either = F.lit(False)
        for word in any_of:
            either = either | F.contains(low, F.lit(word.lower()))
        test = test & either
    return test


def keyword_fraction(df: DataFrame, text: str, any_of: tuple[str, ...], name: str = "fraction") -> DataFrame:
    hits = F.sum(F.when(keyword_test(text, any_of=any_of), 1).otherwise(0))
    return df.agg(F.round(hits / F.count("*"), 3).alias(name))


def ranked_groups(df: DataFrame, by: str, k: int | None = None, name: str = "n") -> DataFrame:
    """Groups by size; the top ``k`` when given."""
    out = df.groupBy(by).agg(F.count("*").alias(name))
    ordered = out.orderBy(F.col(name).desc(), F.col(by).asc())
    return ordered if k is None else ordered.limit(k)
