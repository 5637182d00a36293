"""Exact quantiles without sorting or holding a whole group in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .merge import null_safe

BINS = 4_096


def _scale(v: Column) -> Column:
    """Rises with the value by its order of magnitude: all doubles, infinities and NaN fit into +-2,200."""
    size = F.when(F.isnan(v), 2_150.0).when(F.abs(v) == math.inf, 2_125.0).otherwise(F.log2(F.abs(v)) + 1_100)
    return F.when(v == 0, 0.0).otherwise(F.when(v < 0, -size).otherwise(size))


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of a value between the group's bounds; the bounds themselves are the first and the last one.

    Bounds within a factor of two are divided evenly, wider ones by order of magnitude.
    """
    near = ((lo > 0) & (hi <= 2 * lo)) | ((hi < 0) & (lo >= 2 * hi))
    even = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    share = F.when(near & (F.abs(lo) < math.inf) & (F.abs(hi) < math.inf), even).otherwise(
        (_scale(v) - _scale(lo)) / F.nullif(_scale(hi) - _scale(lo), F.lit(0.0))
    )
    inner = F.least(F.greatest(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(1)), F.lit(bins - 2))
    return F.when(v == lo, 0).when(v == hi, bins - 1).otherwise(inner).cast("int")


def exact_quantile(
    df: DataFrame,
    value: str,
    q: float,
    by: Sequence[str] = (),
    *,
    method: str = "linear",
    name: str = "quantile",
    bins: int = BINS,
) -> DataFrame:
    """Exact ``q``-quantile of ``value`` per group.

    ``linear`` interpolates between neighbours; ``nearest`` takes the element at index
    round-half-even(q * (n - 1)) of the sorted values. NULL values are ignored, NaN is the greatest.

    The built-in exact percentile keeps every distinct value of a group in one task. Here the wanted
    ranks are closed in on: the values of a group are counted in bins between its bounds, which
    combines before the shuffle, the bin that holds the rank gives the next bounds, and so on until
    the bounds meet. Ranks are counted, never estimated, and no task holds more than the bins of a group.
    The first and the last bin hold just the bounds, so each round gets closer; one round finds the order
    of magnitude, each further one adds twelve of the 52 bits of a value, and few values need them all.
    """
    if method not in ("linear", "nearest"):
        raise ValueError(f"unknown method {method!r}")
    by = list(by)
    rows = stage(df.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL"), "quantile-values")

    position: Column = F.lit(q) * (F.col("_n") - 1)
    if method == "nearest":
        position = F.bround(position)
    stats = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    stats = stats.where("_n > 0").withColumn("_at", position)
    ends = F.array(F.floor("_at").cast("bigint"), F.ceil("_at").cast("bigint"))
    wanted = stats.select(*by, "_lo", "_hi", (F.col("_at") - F.floor("_at")).alias("_f"), F.posexplode(ends).alias("_end", "_rank"))
    wanted = stage(wanted, "quantile-ranks")

    while not wanted.where("_lo <> _hi").isEmpty():
        wanted = stage(_closer(rows, wanted, by, bins), "quantile-ranks")
    lower, upper = F.max(F.when(F.col("_end") == 0, F.col("_lo"))), F.max(F.when(F.col("_end") == 1, F.col("_lo")))
    met = wanted.groupBy(*by).agg(lower.alias("_a"), upper.alias("_b"), F.max("_f").alias("_f"))
    between = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f"))
    result = met.select(*by, between.alias(name))
    if by:
        return result
    # Without groups there is one row even where there are no values.
    return result.agg(F.max(name).alias(name))


def _closer(rows: DataFrame, wanted: DataFrame, by: list[str], bins: int) -> DataFrame:
    """The ranks with the bounds of the bin that holds each of them."""
    names = {c: f"_by_{c}" for c in by}
    open_ranks = wanted.where("_lo <> _hi").select(*[F.col(c).alias(n) for c, n in names.items()], "_end", "_rank", "_f", "_lo", "_hi")
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    on = inside & null_safe(list(names.items())) if by else inside
    if by:
        placed = rows.join(open_ranks, on)
    else:
        # Two ranks at most: each value is held against both.
        both = open_ranks.agg(F.collect_list(F.struct("_end", "_rank", "_f", "_lo", "_hi"))).scalar()
        placed = rows.select("_v", F.explode(both).alias("_w")).select("_v", "_w.*").where(inside)
    key = [*by, "_end", "_rank", "_f"]
    counted = placed.groupBy(*key, _bin(F.col("_v"), F.col("_lo"), F.col("_hi"), bins).alias("_bin")).agg(
        F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    running = Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    holds = counted.withColumn("_cum", F.sum("_c").over(running)).where("_cum > _rank AND _cum - _c <= _rank")
    found = holds.select(*by, "_lo", "_hi", "_f", "_end", (F.col("_rank") - F.col("_cum") + F.col("_c")).alias("_rank"))
    done = wanted.where("_lo = _hi").select(*by, "_lo", "_hi", "_f", "_end", "_rank")
    return found.unionByName(done)
