"""What changed between two versions of a keyed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import content_bits


def diff(before: DataFrame, after: DataFrame, key: str, watched: Sequence[str]) -> DataFrame:
    """``(key, change)`` with change insert, update or delete; unchanged keys are left out.

    Both sides shrink to key and 128 bits of content hash before anything moves, and meet in one
    grouping of fixed-width values, a hash aggregation, rather than in a join. The key must be unique on
    each side.
    """
    nothing = F.lit(None).cast("bigint")
    a, b = content_bits(*watched)
    old = before.select(F.col(key), a.alias("_old_a"), b.alias("_old_b"), nothing.alias("_new_a"), nothing.alias("_new_b"))
    new = after.select(F.col(key), nothing.alias("_old_a"), nothing.alias("_old_b"), a.alias("_new_a"), b.alias("_new_b"))
    sides = ("_old_a", "_old_b", "_new_a", "_new_b")
    both = old.unionByName(new).groupBy(key).agg(*[F.max(c).alias(c) for c in sides])
    change = (
        F.when(F.col("_old_a").isNull(), F.lit("insert"))
        .when(F.col("_new_a").isNull(), F.lit("delete"))
        .when((F.col("_old_a") != F.col("_new_a")) | (F.col("_old_b") != F.col("_new_b")), F.lit("update"))
    )
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def apply_changes(index: DataFrame, changes: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Bring a derived index up to date: drop deleted and updated keys, add new and updated rows."""
    stale = changes.where("change <> 'insert'").select(key)
    fresh = after.join(changes.where("change <> 'delete'").select(key), key, "left_semi")
    return index.join(stale, key, "left_anti").unionByName(fresh, allowMissingColumns=True)
