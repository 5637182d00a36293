"""Distributed operators against plain Python on small frames."""

from __future__ import annotations

import json
import math
import random
import statistics

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motorwatch.functions.text import WHITESPACE
from motorwatch.operators import chunking, merge, quantiles, sampling, sessions, snapshot, vectors, worklist
from motorwatch.querybook import registered
from motorwatch.streaming.filters import fold, in_force, note

# ------------------------------------------------------------------- merging


def _rows(df, *order):
    return sorted(tuple(r) for r in df.collect())


def test_merge_inserts_each_new_key_once(frame):
    target = frame([("1", "old"), (None, "null key")], "id string, v string")
    batch = frame([("1", "changed"), ("2", "a"), ("2", "b"), (None, "again"), ("3", "c")], "id string, v string")
    merged = merge.insert_only(target, batch, ["id"], ["v"])
    got = {(r["id"], r["v"]) for r in merged.collect()}
    assert got == {("1", "old"), (None, "null key"), ("2", "a"), ("3", "c")}
    again = merge.insert_only(merged, batch, ["id"], ["v"])
    assert again.count() == merged.count()
    last = merge.insert_only(target, batch, ["id"], ["v"], keep="last")
    assert ("2", "b") in {(r["id"], r["v"]) for r in last.collect()}


def test_keep_one_without_an_order_is_repeatable(frame):
    rows = [("k", str(i), None if i % 3 else i) for i in range(50)]
    a = merge.one_per_key(frame(rows, "k string, v string, n int"), ["k"]).collect()
    b = merge.one_per_key(frame(rows[::-1], "k string, v string, n int").repartition(3), ["k"]).collect()
    assert a == b and len(a) == 1


def test_merge_into_table_adds_columns_and_is_idempotent(spark, frame):
    spark.sql("CREATE SCHEMA IF NOT EXISTS m")
    first = frame([("1", "a"), ("1", "b"), ("2", None)], "id string, v string")
    second = frame([("2", "x", 5), ("3", "y", 6)], "id string, v string, extra int")
    for batch in (first, first, second, second):
        merge.merge_into_table(spark, "m.t", batch, ["id"], ["v"])
    got = {tuple(r) for r in spark.table("m.t").select("id", "v", "extra").collect()}
    assert got == {("1", "a", None), ("2", None, None), ("3", "y", 6)}
    # A later batch without the new column still lands.
    merge.merge_into_table(spark, "m.t", frame([("4", "z")], "id string, v string"), ["id"], ["v"])
    assert spark.table("m.t").count() == 4


def test_provenance_keeps_the_whole_row(frame):
    df = merge.stamp(frame([("1", None, ["x", "y"])], "id string, v string, _overflow array<string>"), "run", "url")
    row = df.first()
    assert json.loads(row["_raw"]) == {"id": "1", "v": None, "_overflow": ["x", "y"]}
    assert (row["_ingest_run_id"], row["_source_url"]) == ("run", "url")


def test_snapshot_diff_and_apply(frame):
    before = frame([("a", 1, "x"), ("b", 2, None), ("c", 3, "z")], "k string, n int, v string")
    after = frame([("a", 1, "x"), ("b", 2, "now"), ("d", 4, None)], "k string, n int, v string")
    changes = snapshot.diff(before, after, "k", ["n", "v"])
    assert {tuple(r) for r in changes.collect()} == {("b", "update"), ("c", "delete"), ("d", "insert")}
    assert snapshot.diff(after, after, "k", ["n", "v"]).count() == 0
    updated = snapshot.apply_changes(before, changes, after, "k")
    assert {tuple(r) for r in updated.collect()} == {tuple(r) for r in after.collect()}


# ----------------------------------------------------------------- quantiles


def _nearest(values, q):
    ordered = sorted(values)
    return ordered[round(q * (len(ordered) - 1))]


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_quantiles_are_exact_for_small_large_and_tied_groups(spark, q):
    rng = random.Random(7)
    groups = {
        "one": [3.5],
        "two": [2.0, 1.0],
        "eleven": [rng.random() for _ in range(11)],
        "large": [rng.gauss(0, 10) for _ in range(30_000)],
        "tied": [float(rng.randint(0, 3)) for _ in range(20_000)],
        "flat": [7.0] * 9_000,
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("large", None)], "g string, v double")
    linear = {r["g"]: r["x"] for r in quantiles.exact_quantile(df, "v", q, ["g"], name="x").collect()}
    nearest = {r["g"]: r["x"] for r in quantiles.exact_quantile(df, "v", q, ["g"], method="nearest", name="x").collect()}
    for g, values in groups.items():
        assert linear[g] == pytest.approx(float(np.quantile(values, q)), abs=1e-9), g
        assert nearest[g] == _nearest(values, q), g


def test_quantiles_of_hard_values(spark):
    """Infinite and huge bounds, all orders of magnitude, neighbouring doubles, NaN: ranks are counted, so the answer is exact."""
    rng = random.Random(3)
    values = [10.0 ** rng.randint(-300, 300) * rng.choice((-1, 1)) for _ in range(300)] + [math.inf, -math.inf, 0.0, 1.7e308, -1.7e308, 5e-324]
    close = 1.0
    for _ in range(200):
        values.append(close)
        close = math.nextafter(close, 2.0)
    ordered = sorted(values) + [math.nan] * 3
    df = spark.createDataFrame([(v,) for v in ordered], "v double")
    for q, bins in ((0.0, 64), (0.3, 64), (0.5, 4096), (0.7, 4096)):
        got = quantiles.exact_quantile(df, "v", q, method="nearest", bins=bins).first()[0]
        assert got == ordered[round(q * (len(ordered) - 1))], q


def test_global_quantile_and_null_group(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(10)], "g string, v double")
    assert quantiles.exact_quantile(df, "v", 0.5).first()[0] == 4.5
    assert quantiles.exact_quantile(df, "v", 0.5, ["g"]).first()["quantile"] == 4.5
    assert quantiles.exact_quantile(df.limit(0), "v", 0.5).collect()[0][0] is None
    assert quantiles.exact_quantile(df.limit(0), "v", 0.5, ["g"]).count() == 0
    with pytest.raises(ValueError):
        quantiles.exact_quantile(df, "v", 0.5, method="other")


# ------------------------------------------------------------------ sampling


def test_exact_size_samples(spark):
    df = spark.range(5_000).withColumn("s", F.when(F.col("id") % 5 == 0, "small").when(F.col("id") % 7 != 0, "big"))
    sizes = {"small": 300, "big": 10_000, "absent": 5}
    got = sampling.exact_sizes(df, ["id"], F.col("s"), sizes)
    counts = {r["s"]: r["count"] for r in got.groupBy("s").count().collect()}
    n_big = df.where("s = 'big'").count()
    assert counts == {"small": 300, "big": n_big}
    again = sampling.exact_sizes(df.repartition(7), ["id"], F.col("s"), sizes)
    assert {r["id"] for r in got.collect()} == {r["id"] for r in again.collect()}
    share = sampling.exact_size(df, ["id"], F.greatest(F.lit(1), F.floor(F.col("_n") * 0.1)))
    assert share.count() == 500
    assert sampling.exact_size(df.limit(3), ["id"], F.greatest(F.lit(1), F.floor(F.col("_n") * 0.1))).count() == 1


def test_exact_size_with_one_bin_holding_everything(spark):
    """Many copies of one id share one draw: the bin at the limit is the whole stratum."""
    df = spark.range(1_000).select(F.lit(1).alias("id"), F.col("id").alias("row"))
    assert sampling.exact_size(df, ["id"], F.lit(37)).count() == 37


def test_stratified_sample_sizes(spark):
    df = spark.range(20_000).withColumn("s", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")))
    got = {r["s"]: r["count"] for r in sampling.stratified(df, "s", {"a": 500, "b": 10**9}, ["id"]).groupBy("s").count().collect()}
    assert got["b"] == 6667 and 400 < got["a"] < 600 and "c" not in got


# ------------------------------------------------------------------- chunks


def _brute(text, spec):
    """Window by window, as one would by hand."""
    if len(text) <= spec.size:
        return [text] if text else []
    out, at = [], 0
    while True:
        end = min(at + spec.size, len(text))
        if end < len(text) and spec.separator:
            found = text[at:end].rfind(spec.separator)
            if found > 0:
                end = at + found + len(spec.separator)
        if text[at:end].strip():
            out.append(text[at:end].strip())
        if end >= len(text):
            return out
        at = max(end - spec.overlap, at + spec.min_advance)


_ALPHABET = st.text(alphabet="ab .\n\t 😀é" + "\x1c", max_size=220)


_SHAPES = [
    (20, 5, ". "), (20, 19, "\n"), (7, 0, ""), (30, 10, "ab"), (20, 5, "\n\n"), (20, 18, "\n", 7), (12, 3, ". . "), (9, 8, "ab "), (10, 0, " "), (6, 2, "a", 4), (15, 14, ""),
]


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(_ALPHABET, min_size=12, max_size=30), shape=st.sampled_from(_SHAPES))
def test_chunks_match_brute_force(spark, texts, shape):
    spec = chunking.ChunkSpec(*shape)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = {r["i"]: r["c"] for r in df.select("i", chunking.chunks("x", spec).alias("c")).collect()}
    assert [got[i] for i in range(len(texts))] == [_brute(t, spec) for t in texts]


def test_chunk_examples(spark):
    df = spark.createDataFrame([("a" * 5000, 1), ("", 2), (None, 3), ("short ", 4)], "body string, extra int")
    rows = chunking.explode_chunks(df, "body").collect()
    assert [(r["extra"], r["chunk_idx"]) for r in rows] == [(1, i) for i in range(7)] + [(4, 0)]
    assert all(len(r["content"]) <= 800 for r in rows) and rows[-1]["content"] == "short "
    assert "body" not in rows[0].asDict()
    paragraphs = "\n\n".join("p" * 300 for _ in range(3))
    spec = chunking.ChunkSpec(400, 50, "\n\n")
    first = chunking.explode_chunks(spark.createDataFrame([(paragraphs,)], "body string"), "body", spec).first()
    assert first["content"] == "p" * 300
    with pytest.raises(ValueError):
        chunking.ChunkSpec(100, 100)


def test_larger_advance_stops_the_crawl(spark):
    text = "a\n" + "b" * 50 + "\n" + "c" * 3000
    df = spark.createDataFrame([(text,)], "x string")
    crawl, steady = (df.select(F.size(chunking.chunks("x", chunking.ChunkSpec(60, 55, "\n", min_advance=n)))).first()[0] for n in (1, 20))
    assert steady < crawl
    assert set(WHITESPACE) == {c for c in map(chr, range(0x3001)) if c.isspace()}


def test_very_long_texts_are_cut_in_the_jvm(spark):
    texts = ["word. " * 200_000, "😀 é" * 100_000, "x" * 1_000_000, "\n\n" * 100_000, "a\n\n" + "b" * 900 + "\n\n" + "c" * 100_000]
    spec = chunking.ChunkSpec()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = {r["i"]: r["c"] for r in df.select("i", chunking.chunks("x", spec).alias("c")).collect()}
    assert [got[i] for i in range(len(texts))] == [_brute(t, spec) for t in texts]


# ------------------------------------------------------------------- vectors


def _vectors(spark, n=400, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)).astype(np.float32)
    data[10] = data[20]  # a tie
    data[30] = 0  # no direction
    rows = [(i, [float(x) for x in v], "even" if i % 2 == 0 else "odd", 2000 + i % 10) for i, v in enumerate(data)]
    rows.append((n, None, "even", 2000))
    return data, spark.createDataFrame(rows, "chunk_id int, embedding array<float>, make_norm string, model_year int").repartition(5)


def _expected(data, query, k, keep=lambda i: True):
    v = data.astype(np.float64)
    q = np.asarray(query, dtype=np.float64)
    norms = np.linalg.norm(v, axis=1)
    scored = [
        (-round(float(v[i] @ q / (norms[i] * np.linalg.norm(q))), 9), i) for i in range(len(v)) if norms[i] > 0 and keep(i)
    ]
    return [i for _, i in sorted(scored)[:k]]


@pytest.mark.parametrize(("queries_per_block", "rows_per_block"), [(512, 2048), (4, 30)])
def test_top_k_matches_numpy(spark, monkeypatch, queries_per_block, rows_per_block):
    monkeypatch.setattr(vectors, "QUERIES_PER_BLOCK", queries_per_block)
    monkeypatch.setattr(vectors, "ROWS_PER_BLOCK", rows_per_block)
    data, corpus = _vectors(spark)
    asked = [(f"q{i}", [float(x) for x in data[i * 20]]) for i in range(9)]
    queries = spark.createDataFrame(asked, "query_id string, query_vector array<float>")
    hits = vectors.top_k(corpus, queries, k=6, columns=["make_norm"]).collect()
    for name, vector in asked:
        got = [r["chunk_id"] for r in sorted((r for r in hits if r["query_id"] == name), key=lambda r: r["rank"])]
        assert got == _expected(data, vector, 6), name


def test_every_vector_asks_for_its_neighbours(spark, tmp_path):
    rows = [(i, [1.0, i / 10], i % 2) for i in range(1, 8)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    hits = registered()["vector_self_search"](spark, str(tmp_path)).collect()
    assert sorted((r["query_id"], r["rank"]) for r in hits) == [(i, n) for i in range(1, 8) for n in (1, 2, 3)]
    assert all(r["vec_id"] == r["query_id"] for r in hits if r["rank"] == 1)


def test_equal_vectors_send_no_more_than_k_rows_a_query_and_block(spark):
    ids = pa.chunked_array([pa.array([5, None, 3, 4], pa.int64())])
    q, r = np.array([0, 0, 0, 0, 1]), np.array([0, 1, 2, 3, 2])
    q, r = vectors._first_of_ties(q, r, np.ones(5), ids, 2)
    assert list(zip(q.tolist(), r.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 2)]
    corpus = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)], "chunk_id bigint, embedding array<float>").repartition(3)
    hits = vectors.top_k(corpus, corpus.selectExpr("chunk_id AS query_id", "embedding AS query_vector"), k=2)
    assert sorted(r["chunk_id"] for r in hits.collect()) == [0] * 60 + [1] * 60


def test_top_k_filters(spark):
    data, corpus = _vectors(spark)
    queries = spark.createDataFrame([("q", [float(x) for x in data[1]])], "query_id string, query_vector array<float>")
    hits = vectors.top_k(corpus, queries, k=500, filters={"make_norm": "odd", "model_year >=": 2005, "no_such_key": 1})
    keep = lambda i: i % 2 == 1 and i % 10 >= 5
    assert [r["chunk_id"] for r in hits.orderBy("rank").collect()] == _expected(data, data[1], 500, keep)
    assert vectors.top_k(corpus, queries.where("false"), k=3).count() == 0
    assert corpus.where(vectors.metadata_filter({"model_year": [2001, 2002]})).count() == 80
    with pytest.raises(ValueError):
        vectors.metadata_filter({"model_year ~": 3})


def test_source_names_are_translated(spark):
    df = spark.createDataFrame([("tsb",), ("investigation",), ("sgo",)], "source_dataset string")
    for asked, kept in (("tsbs", "tsb"), ("investigations", "investigation"), ("sgo", "sgo")):
        rows = df.where(vectors.metadata_filter({"source_dataset": asked})).collect()
        assert [r[0] for r in rows] == [kept]


# ------------------------------------------------------------------ sessions


def test_last_turns_replay_and_next_index(frame):
    turns = frame(
        [("s", 2, "user", "hello"), ("s", 0, "user", "hi"), ("s", 1, "tool", "{}"), ("t", 0, "assistant", "x")],
        "session_id string, turn_idx int, role string, content string",
    )
    assert {(r["session_id"], r["turn_idx"]) for r in sessions.last_turns(turns, 2).collect()} == {("s", 1), ("s", 2), ("t", 0)}
    latest = frame([("s", "hello")], "session_id string, content string")
    assert {(r["session_id"], r["turn_idx"]) for r in sessions.replay(turns, 3, latest).collect()} == {("s", 0), ("t", 0)}
    every = frame([("s",), ("t",), ("new",)], "session_id string")
    assert dict(tuple(r) for r in sessions.next_index(turns, every).collect()) == {"s": 3, "t": 1, "new": 0}
    assert sessions.duplicate_turns(turns).count() == 0
    assert sessions.duplicate_turns(turns.union(turns)).count() == 4


_CHANGE = st.one_of(st.none(), st.sampled_from("pqr"), st.lists(st.sampled_from("wxyz"), max_size=3))
_LOG = st.lists(st.tuples(st.sampled_from("AB"), st.sampled_from(["make", "year"]), _CHANGE), max_size=25)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(log=_LOG)
def test_filters_in_force_match_a_turn_by_turn_fold(spark, log):
    bags: dict[str, dict] = {}
    for session, key, value in log:
        bags[session] = fold(bags.get(session, {}), {key: value})
    want = {(s, k): (list(v) if isinstance(v, list) else v) for s, bag in bags.items() for k, v in bag.items()}
    rows = [
        (s, i, k, v if isinstance(v, str) else None, v if isinstance(v, list) else None) for i, (s, k, v) in enumerate(log)
    ]
    events = spark.createDataFrame(
        rows, "session_id string, turn_idx int, filter_key string, scalar_value string, list_value array<string>"
    )
    got: dict = {}
    for r in sorted(sessions.merge_filters(events).collect(), key=lambda r: (r["turn"], r["pos"])):
        slot = (r["session_id"], r["filter_key"])
        if not r["is_list"]:
            got[slot] = r["value"]
        else:
            got.setdefault(slot, []).extend([] if r["value"] is None else [r["value"]])
    assert got == want


def test_fold_rules():
    bag = fold({}, {"make": "Tesla", "year": [2020]})
    bag = fold(bag, {"make": "Ford", "year": [2021, 2020, 2021], "gone": None})
    assert bag == {"make": "Ford", "year": [2020, 2021]}
    assert fold(bag, {"make": None}) == {"year": [2020, 2021]}
    assert fold(bag, None) == bag


@settings(max_examples=80, deadline=None)
@given(log=st.lists(st.dictionaries(st.sampled_from(["make", "year"]), _CHANGE, max_size=2), max_size=12), order=st.randoms())
def test_filters_are_the_same_in_any_order_of_arrival(log, order):
    want: dict = {}
    for change in log:
        want = fold(want, change)
    arrivals = [*enumerate(log), *enumerate(log[:3])]  # some turns come twice
    order.shuffle(arrivals)
    events: dict = {}
    for turn, change in arrivals:
        note(events, turn, change)
        events = json.loads(json.dumps(events))
    assert in_force(events) == want


# ------------------------------------------------------------------ backlogs


def test_worklists(frame):
    docs = frame([("c",), ("a",), ("b",), ("d",)], "doc_id string")
    done = frame([("a",)], "doc_id string")
    assert [r[0] for r in worklist.pending(docs, done, "doc_id", budget=2).collect()] == ["b", "c"]
    cases = frame([("1", "20200101"), ("1", "20210101"), ("2", "20190101"), (None, "20220101"), ("3", None), ("4", "20200102")], "n string, opened string")
    assert {r[0] for r in worklist.unscraped(cases, frame([("4",)], "n string"), "n", "opened", "20200101").collect()} == {"1"}


def test_a_large_budget_is_picked_by_all_tasks(spark, frame, plan, monkeypatch):
    monkeypatch.setattr(worklist, "SMALL_BUDGET", 10)
    ids = [None, *(str(i) for i in range(500)), "7", "7"]
    docs = frame([(i, n) for n, i in enumerate(ids)], "doc_id string, n int").repartition(6)
    done = frame([(str(i),) for i in range(0, 500, 2)], "doc_id string")
    left = sorted((i for i in ids if i is None or int(i) % 2), key=lambda i: (i is not None, i))
    for budget in (11, 200, 252, 253, 1000):
        picked = worklist.pending(docs, done, "doc_id", budget=budget)
        assert picked.columns == ["doc_id", "n"] and "TakeOrdered" not in plan(picked)
        assert [r["doc_id"] for r in picked.collect()] == left[:budget]


def test_point_lookup_reports_missing_and_long_ids(frame):
    table = frame([(10, "x"), (10, "a"), (11, "b")], "id int, v string")
    asked = frame([("10",), ("99",), ("10",), ("9" * 65,)], "id string")
    got = worklist.point_lookup(asked, table, "id", ["v"])
    assert {tuple(r) for r in got.collect()} == {("10", True, "a", None), ("99", False, None, None), ("9" * 65, False, None, "id too long")}


def test_p95_against_statistics(spark):
    values = [float(i * i % 97) for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = statistics.quantiles(values, n=100, method="inclusive")[94]
    assert quantiles.exact_quantile(df, "v", 0.95).first()[0] == pytest.approx(want)


def test_only_the_move_of_the_end_that_was_found_is_tried():
    for spec in (chunking.ChunkSpec(400, 50, ". "), chunking.ChunkSpec(12, 9, "ab", 4), chunking.ChunkSpec(6, 0, " ")):
        pattern = chunking.window_pattern(spec, True)
        moves = pattern[pattern.rindex("(?:") + 3 : -1].split("|")
        assert [m[:2] for m in moves] == [f"\\{n}" for n in range(2, 2 + pattern.count("()"))]
