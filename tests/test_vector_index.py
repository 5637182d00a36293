from __future__ import annotations

import numpy as np
import pytest
from motorwatch.operators import vector_index, vectors

from test_operators import _expected, _vectors


def ids(hits) -> dict:
    found: dict = {}
    for r in hits.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["chunk_id"])
    return found


def asked(spark, data, step=20):
    rows = [(f"q{i}", [float(x) for x in data[i]]) for i in range(0, len(data), step) if np.any(data[i])]
    return rows, spark.createDataFrame(rows, "query_id string, query_vector array<float>")


@pytest.mark.parametrize(("n_lists", "rows_per_slot", "k"), [(1, 100_000, 6), (20, 100_000, 6), (20, 7, 6), (300, 5, 6), (12, 50, 500)])
def test_the_index_gives_the_exact_result(spark, tmp_path, n_lists, rows_per_slot, k):
    data, corpus = _vectors(spark)
    rows, queries = asked(spark, data)
    index = vector_index.build_index(corpus, str(tmp_path / "index"), n_lists=n_lists, rows_per_slot=rows_per_slot)
    got = ids(vector_index.search_index(spark, index, queries, k=k, columns=["make_norm"]))
    assert got == {name: _expected(data, vector, k) for name, vector in rows}
    assert index.rows(spark).count() == 399, "rows without a direction are left out, all others are indexed"


def test_filters_and_no_queries(spark, tmp_path):
    data, corpus = _vectors(spark)
    rows, queries = asked(spark, data, 50)
    index = vector_index.build_index(corpus, str(tmp_path / "index"), n_lists=15)
    hits = vector_index.search_index(spark, index, queries, k=9, filters={"make_norm": "odd", "model_year >=": 2005, "other": 1})
    keep = lambda i: i % 2 == 1 and i % 10 >= 5
    assert ids(hits) == {name: _expected(data, vector, 9, keep) for name, vector in rows}
    assert vector_index.search_index(spark, index, queries.where("false"), k=3).collect() == []


def test_no_rows(spark, tmp_path):
    data, corpus = _vectors(spark)
    _, queries = asked(spark, data)
    index = vector_index.build_index(corpus.where("false"), str(tmp_path / "index"))
    assert vector_index.search_index(spark, index, queries, k=3).collect() == []


def test_lists_that_cannot_hold_a_hit_are_not_read(spark, tmp_path, plan):
    """Rows in tight groups: a query in one of them reads that group's list alone."""
    rng = np.random.default_rng(7)
    centers = np.eye(8)
    data = np.concatenate([centers[g] + rng.normal(size=(50, 8)) * 0.01 for g in range(8)])
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "chunk_id int, embedding array<double>")
    index = vector_index.build_index(corpus, str(tmp_path / "index"), n_lists=40)
    assert index.lists(spark).count() >= 8
    known = vector_index.Lists(index.lists(spark).orderBy("_list").collect())
    angles = known.angles(data[:1])
    floors = np.array([0.999])
    assert known.first(angles, 5).sum() == 1 and known.possible(angles, floors).sum() < index.lists(spark).count() / 2
    queries = spark.createDataFrame([("q", [float(x) for x in data[0]])], "query_id string, query_vector array<double>")
    hits = vector_index.search_index(spark, index, queries, k=5)
    assert ids(hits)["q"] == _expected(data, data[0], 5)
    asked_q = queries.selectExpr("query_id AS _q", "query_vector AS _v")
    pairs = vector_index._pairs(asked_q, known, 5, later=False)
    slots = index.lists(spark).select("_list", "slots")
    text = plan(vector_index._search(index, pairs, index.rows(spark), slots, 5, "query_id", ["chunk_id"]))
    scans = [line.split("PartitionFilters")[1] for line in text.splitlines() if "PartitionFilters" in line and "embedding" in line]
    assert scans and all("_list#" in line.split("PushedFilters")[0] for line in scans)


def test_bounds_never_lose_a_row():
    rng = np.random.default_rng(5)
    rows, centers, queries = (vectors._unit_rows(rng.normal(size=(n, 6))) for n in (400, 9, 30))
    nearest = np.argmax(rows @ centers.T, axis=1)
    angles = np.arccos(np.clip((rows * centers[nearest]).sum(axis=1), -1, 1))
    lists = [
        {"_list": i, "center": centers[i], "n": int((nearest == i).sum()), "near": angles[nearest == i].min(initial=9), "far": angles[nearest == i].max(initial=0)}
        for i in range(9)
    ]
    known = vector_index.Lists([r for r in lists if r["n"]])
    scores = queries @ rows.T
    for k in (1, 5, 50):
        floors = np.sort(scores, axis=1)[:, -k]
        possible = known.possible(known.angles(queries), floors)
        for q in range(len(queries)):
            for row in np.flatnonzero(scores[q] >= floors[q]):
                assert possible[q, list(known.ids).index(nearest[row])]
        assert not possible.all()


def test_many_queries_meet_as_many_slots_as_the_rows_ask_for(spark, plan):
    data, corpus = _vectors(spark)
    rows, queries = asked(spark, data)
    few = vectors.top_k(corpus, queries, k=6)
    many = vectors.top_k(corpus, queries, k=6, broadcast_bytes=0, rows_per_slot=30)
    want = {name: _expected(data, vector, 6) for name, vector in rows}
    assert ids(few) == want and ids(many) == want
    assert "BroadcastHashJoin" in plan(few) and "14, " not in plan(few)
    assert "sequence(0, 13" in plan(many) or "Generate explode" in plan(many)


def test_few_vectors_meet_all_centroids_at_a_time():
    import pyarrow as pa

    from motorwatch.operators import vector_index

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_001))], names=["i"])
    parts = list(vector_index._steps(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) == vector_index.VECTORS_PER_STEP
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(10_001))
