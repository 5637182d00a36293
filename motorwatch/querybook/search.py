"""Vector search over the given embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.vector_index import build_index, search_index
from ..operators.vectors import top_k
from ..plans.evaluation import retrieval_gate as gate
from ..session import scratch_path
from .registry import Tables, query

# One question per label: the vector of its lowest id. The number of labels does not grow.
_ASKED_SQL = "asked AS (SELECT label AS query_id, min_by(embedding, vec_id) AS v FROM embeddings GROUP BY label)"


def _asked(t: Tables):
    return t.embeddings.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query_vector"))


def _ranked_sql(where: str = "TRUE") -> str:
    return f"""WITH {_ASKED_SQL}, scored AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]), 9) AS score
        FROM asked, embeddings WHERE {where}),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM scored)"""


_HITS = "SELECT query_id, vec_id, label, round(score, 6) AS score, rn::INTEGER AS rank FROM ranked WHERE rn <= {k}"


def _search(t: Tables, **options):
    hits = top_k(t.embeddings, _asked(t), id_col="vec_id", columns=["label"], **options)
    return hits.withColumn("score", F.round("score", 6))


@query("vector_topk", f"{_ranked_sql()} {_HITS.format(k=8)}")
def vector_topk(t: Tables):
    return _search(t)


@query("filtered_topk", f"{_ranked_sql('label >= 3')} {_HITS.format(k=5)}")
def filtered_topk(t: Tables):
    """A range filter and a key the index does not know, which is ignored."""
    return _search(t, k=5, filters={"label >=": 3, "bulletin_year": 1}, allowed=frozenset({"label"}))


@query(
    "retrieval_gate",
    f"""{_ranked_sql()}, top AS (SELECT query_id, count(*) AS n_hits, bool_or(rn = 1 AND label = query_id) AS hit FROM ranked WHERE rn <= 8 GROUP BY query_id)
        SELECT count(*) AS n_queries, count(*) FILTER (WHERE hit) AS n_pass, avg(n_hits) AS avg_hits,
          count(*) FILTER (WHERE hit) >= ceil(count(*) * 0.8) AS ok FROM top""",
)
def retrieval_gate(t: Tables):
    """Each question's best hit must carry the question's own label."""
    top = _search(t).groupBy("query_id").agg(
        F.count("*").alias("n_hits"), F.min_by("label", "rank").alias("best_label")
    )
    return gate(top, F.col("best_label") == F.col("query_id"))


@query(
    "retrieval_latency",
    f"""{_ranked_sql()}, top AS (SELECT query_id, count(*) AS n_hits, bool_or(rn = 1 AND label = query_id) AS hit, sum(vec_id % 97)::DOUBLE AS ms FROM ranked WHERE rn <= 8 GROUP BY query_id)
        SELECT count(*) AS n_queries, count(*) FILTER (WHERE hit) AS n_pass, avg(n_hits) AS avg_hits, count(*) FILTER (WHERE hit) >= ceil(count(*) * 0.8) AS ok,
          quantile_cont(ms, 0.5) AS p50_ms, quantile_cont(ms, 0.95) AS p95_ms FROM top""",
)
def retrieval_latency(t: Tables):
    """The gate with latencies, made here from the hits' ids."""
    top = _search(t).groupBy("query_id").agg(
        F.count("*").alias("n_hits"), F.min_by("label", "rank").alias("best_label"), F.sum(F.col("vec_id") % 97).cast("double").alias("ms")
    )
    return gate(top, F.col("best_label") == F.col("query_id"), latency_ms="ms")


_NEAREST_SQL = """WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
       s AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM u a, u b WHERE a.vec_id % 20 = 0 {where}),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
       SELECT query_id, vec_id, rn::INTEGER AS rank{more} FROM r WHERE rn <= {k}"""


def _askers(t: Tables):
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(
    "vector_self_search",
    """WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
       s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM u a, u b)
       SELECT query_id, vec_id, rn::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 3""",
)
def vector_self_search(t: Tables):
    """Every embedding asks for its three nearest among all."""
    asked = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return top_k(t.embeddings, asked, k=3, id_col="vec_id").select("query_id", "vec_id", "rank")


@query("vector_index_search", _NEAREST_SQL.format(where="", more=", label", k=8))
def vector_index_search(t: Tables):
    """The same question to a stored index with lists: exact, and lists that cannot hold a hit are skipped."""
    index = build_index(t.embeddings, scratch_path(t.spark, "vector-index"), id_col="vec_id")
    return search_index(t.spark, index, _askers(t), k=8, columns=["label"]).select("query_id", "vec_id", "rank", "label")


@query("vector_index_filtered", _NEAREST_SQL.format(where="AND b.label >= 3", more=", label", k=5))
def vector_index_filtered(t: Tables):
    """The index with a filter on its rows: lists hold fewer rows then than they count, and more of them are searched."""
    index = build_index(t.embeddings, scratch_path(t.spark, "vector-index"), id_col="vec_id")
    hits = search_index(t.spark, index, _askers(t), k=5, columns=["label"], filters={"label >=": 3}, allowed=frozenset({"label"}))
    return hits.select("query_id", "vec_id", "rank", "label")
