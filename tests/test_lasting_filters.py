from __future__ import annotations

import json
import random

import pytest
from motorwatch.streaming import filters as S
from motorwatch.streaming.ingest import state_on_disk


@pytest.fixture
def data_batches_only(spark):
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def in_order(turns) -> dict:
    bag: dict = {}
    for _, change in sorted(turns, key=lambda x: x[0]):
        bag = S.fold(bag, change)
    return bag


def states_of(turns, disorder: int) -> dict:
    states: dict = {}
    last = -1
    for turn, change in turns:
        last = max(last, turn)
        for name, value in (change or {}).items():
            S.note_compact(states.setdefault(name, {"reset": None, "value": None, "first": None, "items": [], "lists": {}}), turn, value)
        for held in states.values():
            S.compact(held, last - disorder)
    return states


def random_turns(draw: random.Random, n: int) -> list:
    def value():
        return draw.choice([None, "x", 7, ["a"], ["a", "b", "a"], ["c", "b"], []])

    return [(i, draw.choice([None, {draw.choice("kl"): value()}, {"k": value(), "l": value()}])) for i in range(n)]


def test_compact_state_equals_folding_in_order():
    draw = random.Random(2)
    for _ in range(300):
        turns = random_turns(draw, draw.randint(0, 25))
        near = sorted(turns, key=lambda x: x[0] + draw.random() * 5)
        assert S.bag_of(states_of(near, 5)) == in_order(turns), turns
        shuffled = draw.sample(turns, len(turns))
        assert S.bag_of(states_of(shuffled, 25)) == in_order(turns), turns


def test_lists_may_be_late_without_bound():
    draw = random.Random(3)
    for _ in range(200):
        turns = [(i, {"k": draw.choice([["a"], ["b", "b"], ["c", "a"], ["d"]])}) for i in range(20)]
        assert S.bag_of(states_of(draw.sample(turns, 20), 2)) == in_order(turns)


def test_state_is_bounded_for_a_session_that_adds_the_same_items():
    def size(n):
        return len(json.dumps(states_of([(i, {"k": ["a", "b"]}) for i in range(n)], 8)))

    assert abs(size(5000) - size(500)) < 100


def test_stream_with_map_state_and_lifetime(spark, tmp_path, data_batches_only):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    draw = random.Random(4)
    sessions = {f"s{i}": random_turns(draw, 12) for i in range(4)}
    arriving = [(s, t, json.dumps(c) if c else None) for s, turns in sessions.items() for t, c in turns]
    draw.shuffle(arriving)
    schema = "session_id string, turn_idx bigint, filters string"
    bags: dict = {}

    def keep(batch, _):
        bags.update({r["session_id"]: json.loads(r["filters"]) for r in batch.collect()})

    for lot in (arriving[:20], arriving[20:]):
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(source)
        stream = S.accumulate_with_lifetime(spark.readStream.schema(schema).parquet(source), lifetime_ms=3_600_000)
        with state_on_disk(spark):
            query = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", progress).foreachBatch(keep).start()
            query.awaitTermination()
    assert bags == {s: in_order(turns) for s, turns in sessions.items()}


def test_state_that_is_not_touched_expires(spark, tmp_path, data_batches_only):
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    schema, bags = "session_id string, turn_idx bigint, filters string", []

    def keep(batch, _):
        bags.extend((r["session_id"], json.loads(r["filters"])) for r in batch.collect())

    for row in (("a", 1, '{"k": ["x"]}'), ("b", 1, '{"k": 1}'), ("a", 2, '{"k": ["y"]}')):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(source)
        stream = S.accumulate_with_lifetime(spark.readStream.schema(schema).parquet(source), lifetime_ms=1)
        with state_on_disk(spark):
            write = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", progress)
            write.foreachBatch(keep).start().awaitTermination()
    assert bags == [("a", {"k": ["x"]}), ("b", {"k": 1}), ("a", {"k": ["y"]})]
