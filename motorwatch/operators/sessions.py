"""Conversation logs: last turns, next index, accumulated filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def last_turns(
    turns: DataFrame, n: int, session: str = "session_id", turn: str = "turn_idx", ties: Sequence[str] = ()
) -> DataFrame:
    """The ``n`` latest turns of every session.

    Ranking with an upper limit becomes a group limit below the shuffle, so each task sends at
    most ``n`` rows per session however long a session is.
    """
    order = Window.partitionBy(session).orderBy(F.col(turn).desc(), *[F.col(c).desc() for c in ties])
    return turns.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def replay(
    turns: DataFrame,
    n: int,
    latest: DataFrame | None = None,
    session: str = "session_id",
    turn: str = "turn_idx",
    role: str = "role",
    content: str = "content",
) -> DataFrame:
    """Turns to send again: the last ``n``, without tool turns and without the user turn just added.

    ``latest`` holds ``(session, content)`` of the message being answered.
    """
    recent = last_turns(turns, n, session, turn).where(F.col(role) != "tool")
    if latest is None:
        return recent
    asked = latest.select(F.col(session).alias("_s"), F.col(content).alias("_c")).distinct()
    same = (F.col(session) == F.col("_s")) & (F.col(content) == F.col("_c")) & (F.col(role) == "user")
    return recent.join(asked, same, "left_anti")


def next_index(turns: DataFrame, sessions: DataFrame, session: str = "session_id", turn: str = "turn_idx") -> DataFrame:
    """Index of the next turn per session: the highest plus one, 0 for a session without turns."""
    top = turns.groupBy(session).agg(F.max(turn).alias("_top"))
    return sessions.join(top, session, "left").select(
        *sessions.columns, (F.coalesce(F.col("_top"), F.lit(-1)) + 1).cast("bigint").alias("next_turn_idx")
    )


def duplicate_turns(turns: DataFrame, session: str = "session_id", turn: str = "turn_idx") -> DataFrame:
    """Turn indexes used more than once, which a session log must not hold."""
    return turns.groupBy(session, turn).agg(F.count("*").alias("n")).where("n > 1")


def merge_filters(
    events: DataFrame,
    session: str = "session_id",
    turn: str = "turn_idx",
    key: str = "filter_key",
    scalar: str = "scalar_value",
    items: str = "list_value",
) -> DataFrame:
    """The filters in force at the end of each session, one row per value.

    Input: one row per (session, turn, key) with either a scalar, a list, or neither, which
    clears the key. Later scalars replace, lists add what is new to the list in force, in order
    of first mention, and a list after a scalar replaces it.

    Folding turn after turn would need a whole session in one task. The same outcome follows
    from a few grouped maxima: the last event that was not a list (everything before it is
    void) and the last list, then, for lists since that point, the first mention of each item.
    All of it combines map-side.

    Output: ``session, key, is_list, value, turn, pos``; ``(turn, pos)`` is the order of a
    list's items. An empty list in force is one row without a value.
    """
    # Events often come out of parsed JSON and are looked at four times: they are worked out once.
    events = stage(events.select(session, turn, key, scalar, items), "filter-events")
    is_list = F.col(items).isNotNull()
    state = events.groupBy(F.col(session).alias("_s"), F.col(key).alias("_k")).agg(
        F.max(F.when(~is_list, F.col(turn))).alias("_reset"),
        F.max_by(F.col(scalar), F.when(~is_list, F.col(turn))).alias("_scalar"),
        F.max(F.when(is_list, F.col(turn))).alias("_list"),
        F.max(F.when(is_list & (F.size(items) > 0), F.col(turn))).alias("_filled"),
    )
    start = F.coalesce(F.col("_reset"), F.lit(-(2**62)))
    ends_in_list = F.coalesce(F.col("_list") > start, F.lit(False))
    has_items = F.coalesce(F.col("_filled") > start, F.lit(False))

    live = state.where(has_items).select("_s", "_k", start.alias("_start"))
    lists = events.where(is_list).select(session, key, turn, F.col(items).alias("_items"))
    lists = lists.join(live, (F.col(session) == F.col("_s")) & (F.col(key) == F.col("_k")))
    lists = lists.where(F.col(turn) > F.col("_start"))
    listed = (
        lists.select(session, key, turn, F.posexplode("_items").alias("pos", "value"))
        .groupBy(session, key, "value")
        .agg(F.min(F.struct(F.col(turn).alias("turn"), F.col("pos").alias("pos"))).alias("_at"))
        .select(session, key, F.lit(True).alias("is_list"), "value", "_at.turn", "_at.pos")
    )
    # The list that opens a key is taken as it is; only what is added later is checked for repeats.
    opening = lists.groupBy(session, key).agg(F.min_by("_items", turn).alias("_items"), F.min(turn).alias("turn"))
    repeats = (
        opening.select(session, key, "turn", "_items", F.posexplode("_items").alias("pos", "value"))
        .where(F.array_position("_items", F.col("value")) <= F.col("pos"))
        .select(session, key, F.lit(True).alias("is_list"), "value", "turn", "pos")
    )
    bare = state.where(F.when(ends_in_list, ~has_items).otherwise(F.col("_scalar").isNotNull())).select(
        F.col("_s").alias(session),
        F.col("_k").alias(key),
        ends_in_list.alias("is_list"),
        F.when(~ends_in_list, F.col("_scalar")).alias("value"),
        F.when(ends_in_list, F.col("_list")).otherwise(F.col("_reset")).alias("turn"),
        F.lit(0).alias("pos"),
    )
    return bare.unionByName(listed).unionByName(repeats)
