"""Conversation logs: history, next index, filters in force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions
from .registry import Tables, query


@query(
    "last_n_turns",
    """SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS rn FROM conversations)
       WHERE rn <= 3""",
)
def last_n_turns(t: Tables):
    return sessions.last_turns(t.conversations, 3, "conv_id", "turn", ["role", "text"])


@query(
    "replay_history",
    """WITH recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4),
       asked AS (SELECT conv_id, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id)
       SELECT r.conv_id, r.turn, r.role FROM recent r LEFT JOIN asked a ON r.conv_id = a.conv_id AND r.text = a.text AND r.role = 'user'
       WHERE a.conv_id IS NULL AND r.role <> 'system'""",
)
def replay_history(t: Tables):
    """What is sent again with the latest user message; system turns play the tool turns here."""
    turns = t.conversations.withColumn("role", F.when(F.col("role") == "system", "tool").otherwise(F.col("role")))
    asked = turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    out = sessions.replay(turns, 4, asked, session="conv_id", turn="turn", content="text")
    return out.select("conv_id", "turn", "role")


@query(
    "next_turn_idx",
    """WITH s AS (SELECT DISTINCT conv_id FROM conversations UNION SELECT DISTINCT -1 - conv_id FROM conversations)
       SELECT conv_id, (coalesce(max(turn), -1) + 1)::BIGINT AS next_turn_idx FROM s LEFT JOIN conversations USING (conv_id) GROUP BY conv_id""",
)
def next_turn_idx(t: Tables):
    """Known sessions and as many that have no turn yet."""
    known = t.conversations.select("conv_id").distinct()
    both = known.union(known.select((-1 - F.col("conv_id")).alias("conv_id")))
    return sessions.next_index(t.conversations, both, "conv_id", "turn")


@query(
    "duplicate_turns",
    "SELECT user_id, (props->>'$.k')::INTEGER AS k, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_turns(t: Tables):
    rows = t.events.select("user_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return sessions.duplicate_turns(rows, "user_id", "k")


# Every event sets one filter of its user: a list, a scalar, an empty list, or nothing at all.
_LIST = "CASE WHEN k % 10 = 0 THEN NULL WHEN k % 17 = 1 THEN {empty} WHEN k % 2 = 1 THEN {open}CAST(k % 7 AS {t}), CAST(k % 5 AS {t}){close} END"
_SCALAR = "CASE WHEN k % 10 <> 0 AND k % 17 <> 1 AND k % 2 = 0 THEN CAST(k AS {t}) END"


@query(
    "merge_filters",
    f"""WITH e AS (SELECT user_id, event_id, event_type, (props->>'$.k')::INTEGER AS k FROM events),
       f AS (SELECT user_id, event_id, event_type, {_SCALAR.format(t='VARCHAR')} AS sv, {_LIST.format(empty='[]::VARCHAR[]', open='[', close=']', t='VARCHAR')} AS lv FROM e),
       b AS (SELECT *, coalesce(max(CASE WHEN lv IS NULL THEN event_id END) OVER (PARTITION BY user_id, event_type), -1) AS reset FROM f),
       live AS (SELECT user_id, event_type, event_id, unnest(lv) AS value, generate_subscripts(lv, 1) - 1 AS pos FROM b WHERE lv IS NOT NULL AND len(lv) > 0 AND event_id > reset),
       items AS (SELECT user_id, event_type, value, min((event_id, pos)) AS seen FROM live GROUP BY ALL),
       opening AS (SELECT user_id, event_type, min(event_id) AS event_id FROM b WHERE lv IS NOT NULL AND event_id > reset GROUP BY ALL),
       repeats AS (SELECT l.user_id, l.event_type, l.value, l.event_id, l.pos FROM live l JOIN opening USING (user_id, event_type, event_id)
         WHERE EXISTS (SELECT 1 FROM live m WHERE m.event_id = l.event_id AND m.value = l.value AND m.pos < l.pos)),
       scalars AS (SELECT b.user_id, b.event_type, b.sv AS value, b.event_id FROM b WHERE event_id = reset AND sv IS NOT NULL
         AND NOT EXISTS (SELECT 1 FROM b x WHERE x.user_id = b.user_id AND x.event_type = b.event_type AND x.lv IS NOT NULL AND x.event_id > b.reset)),
       empties AS (SELECT user_id, event_type, max(event_id) AS event_id FROM b WHERE lv IS NOT NULL AND event_id > reset GROUP BY ALL HAVING max(len(lv)) = 0)
       SELECT user_id, event_type AS filter_key, TRUE AS is_list, value, seen[1] AS turn, seen[2]::INTEGER AS pos FROM items
       UNION ALL SELECT user_id, event_type, TRUE, value, event_id, pos::INTEGER FROM repeats
       UNION ALL SELECT user_id, event_type, FALSE, value, event_id, 0 FROM scalars
       UNION ALL SELECT user_id, event_type, TRUE, NULL, event_id, 0 FROM empties""",
)
def merge_filters(t: Tables):
    rows = t.events.withColumn("k", F.get_json_object("props", "$.k").try_cast("int")).select(
        "user_id",
        "event_id",
        F.col("event_type").alias("filter_key"),
        F.expr(_SCALAR.format(t="string")).alias("scalar_value"),
        F.expr(_LIST.format(empty="CAST(array() AS array<string>)", open="array(", close=")", t="string")).alias("list_value"),
    )
    return sessions.merge_filters(rows, "user_id", "event_id")
