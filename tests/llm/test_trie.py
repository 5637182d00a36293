from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from motorwatch.llm import prefix_trie as P
from motorwatch.llm.queries import rebuilt_conversations

SCHEMA = "conv_id long, turn int, role string, text string, who string"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def ordered(rows):
    """Conversations as lists of (role, text)."""
    talk = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        digest = hashlib.md5(f"{len(role)}|{role}{text}".encode()).hexdigest()
        talk[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    return {c: [x[2] for x in sorted(turns)] for c, turns in talk.items()}


def expected(talk: dict) -> list[tuple]:
    """The trie by walking every prefix of every conversation."""
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in talk.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    least = {k: min((c for c in v if c is not None), default=None) for k, v in members.items()}
    leaves, saved = Counter(), Counter()
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
    rows = []
    for k, v in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in v if c is not None and len(talk[c]) == len(k)))
        parent = least[k[:-1]] if k else None
        rows.append((least[k], len(k), parent, len(v), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def random_rows(seed: int, n: int) -> list[tuple]:
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(draw.randint(1, 12)):
            rows.append((c, draw.choice([t, t, t, None]), draw.choice(["user", "assistant", None]), draw.choice(["a", "é", None, "", "bb"]), "x"))
    rows += [(n + 1 + c, t, "user", f"same {t}", "x") for c in range(20) for t in range(30)]
    rows += [(n + 30, t, "user", "long" if t < 40 else f"{t}", "x") for t in range(90)]
    rows += [(None, t, "user", f"same {t}", "x") for t in range(3)]
    return rows + rows[:5]


@pytest.mark.parametrize(("shards", "light", "held", "block"), [(4096, 1000, 1 << 18, 1 << 14), (4, 1, 2, 3), (50, 2, 1, 1)])
def test_nodes_equal_brute_force(spark, monkeypatch, shards, light, held, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rows = random_rows(1, 60)
    placed = P.place_turns(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = [tuple(r[f] for f in FIELDS) for r in P.prefix_trie(placed, shards=shards, light=light, held=held).collect()]
    assert sorted(got, key=repr) == expected(ordered(rows))


def test_hot_keys_take_the_broadcast_side(spark, monkeypatch):
    monkeypatch.setattr(P, "LIGHT", 2)
    rows = random_rows(2, 40)
    got = [tuple(r[f] for f in FIELDS) for r in P.prefix_trie(P.place_turns(spark.createDataFrame(rows, SCHEMA)), light=2, shards=9).collect()]
    assert sorted(got, key=repr) == expected(ordered(rows))


def test_bounded_number_of_heavy_nodes(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_HEAVY", 4)
    rows = random_rows(3, 30)
    got = [tuple(r[f] for f in FIELDS) for r in P.prefix_trie(P.place_turns(spark.createDataFrame(rows, SCHEMA)), light=1, shards=1000).collect()]
    assert sorted(got, key=repr) == expected(ordered(rows))


def test_rebuilt_conversations(spark):
    rows = random_rows(4, 60) + [(1000 + c, 0, "user", "alone", "x") for c in range(1, 1000, 7) if c % 5]
    talk = ordered(rows)
    built = {}
    for c, turns in talk.items():
        h = zlib.crc32(str(c).encode()) % 9 if c is not None else 0
        built[c] = (talk.get(c - c % 5, [])[:h] if c is not None else []) + turns[h:]
    placed, everyone = rebuilt_conversations(P.place_turns(spark.createDataFrame(rows, SCHEMA)))
    assert any(not b for b in built.values()), "a conversation without turns is among them"
    got = [tuple(r[f] for f in FIELDS) for r in P.prefix_trie(placed, everyone).collect()]
    assert sorted(got, key=repr) == expected(built)


def test_place_of_turns_over_many_ranges(spark):
    rows = [(7, (i * 37) % 400, "user", str(i % 7)) for i in range(400)] + [(8, None, "user", "t")] * 9
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = P.place_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((r["who"]["id"], r["at"]) for r in placed) == [*((7, i) for i in range(1, 401)), *((8, i) for i in range(1, 10))]


def test_queue_spills_and_gives_messages_in_order():
    draw = random.Random(6)
    queue, want = P.Queue(held=3), defaultdict(lambda: [0, 0])
    for _ in range(200):
        d, k, v = draw.randint(0, 9), draw.choice("abcdef"), draw.randint(0, 9)
        queue.push(d, k, v, 1)
        want[d, k] = [want[d, k][0] + v, want[d, k][1] + 1]
    assert len(queue.runs) > 10 and len(queue.heap) <= 3
    for d, k in sorted(want, key=lambda x: (-x[0], x[1])):
        assert queue.take(d, k) == want[d, k]
    assert not len(queue)


def test_empty_table(spark):
    placed = P.place_turns(spark.createDataFrame([], SCHEMA))
    assert P.prefix_trie(placed).collect() == []
