"""Exact nearest-vector search with metadata filters."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import stage

# Filter keys the index knows, and the plural names also accepted for sources.
FILTER_KEYS = frozenset({"source_dataset", "make_norm", "model_year", "component_group", "oem_group"})
SOURCE_NAMES = {"tsbs": "tsb", "investigations": "investigation"}
TOP_K = 8

_COMPARE = {
    "": lambda c, v: c == v,
    "=": lambda c, v: c == v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
}
# Queries and corpus rows meet in blocks of about these many vectors; a task holds one of each.
QUERIES_PER_BLOCK = 512
ROWS_PER_BLOCK = 2_048
#: Query vectors up to this size are broadcast as they are; beyond it the corpus is dealt over slots of so many rows, and each slot gets a copy.
BROADCAST_BYTES = 32 << 20
ROWS_PER_SLOT = 100_000
SCORE_DIGITS = 9


def metadata_filter(filters: Mapping[str, object] | None, allowed: frozenset[str] = FILTER_KEYS) -> Column:
    """Filters such as ``{"make_norm": "Tesla", "model_year >=": 2020}`` as one predicate.

    Unknown keys are ignored, a list means any of its values. An unknown comparison is an error.
    """
    tests = [F.lit(True)]
    for key, value in (filters or {}).items():
        name, _, op = key.strip().partition(" ")
        if name not in allowed:
            continue
        if op.strip() not in _COMPARE:
            raise ValueError(f"unknown comparison in filter {key!r}")
        if name == "source_dataset" and isinstance(value, str):
            value = SOURCE_NAMES.get(value, value)
        column = F.col(name)
        tests.append(column.isin(*value) if isinstance(value, (list, tuple)) else _COMPARE[op.strip()](column, value))
    return reduce(lambda a, b: a & b, tests)


def _unit_rows(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(norms > 0, vectors / norms, np.nan)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def top_k(
    corpus: DataFrame,
    queries: DataFrame,
    *,
    k: int = TOP_K,
    id_col: str = "chunk_id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    columns: Sequence[str] = (),
    filters: Mapping[str, object] | None = None,
    allowed: frozenset[str] = FILTER_KEYS,
    broadcast_bytes: int = BROADCAST_BYTES,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """The ``k`` corpus rows with the highest cosine per query, ties broken by id.

    Filters run before any vector is touched. Both sides are packed into blocks, one row each, and
    every block of the corpus meets every block of queries. Queries of a measured size below
    ``BROADCAST_BYTES`` are broadcast, and the corpus stays where it lies. More queries meet the corpus in a join on
    a slot: as many slots as the corpus' rows ask for, so tasks stay of one size whatever the corpus' is. (A stored index,
    :mod:`.vector_index`, reads less.) A task multiplies two blocks at a time and passes on ``k`` rows per query and block at most, fewer once it
    has seen better ones, never all pairs. Nothing passes through the driver but the number of queries,
    and the plan is the same for any number. Scores are rounded to nine digits before ranking, so that
    the order does not hang on the last bits of a sum. Zero vectors have no direction and no score.
    """
    kept = [id_col, *columns]
    source = corpus.where(metadata_filter(filters, allowed)).where(F.col(vector).isNotNull())
    asked = queries.select(F.col(query_id).alias("_q"), F.col(query_vector).alias("_v")).where("_v IS NOT NULL")
    id_type = asked.schema["_q"].dataType

    stored = stage(asked, "vector-queries")
    asked_rows, asked_bytes = stored.agg(F.count("*"), F.sum(F.size("_v").cast("long") * 8)).first()
    count = -(-asked_rows // QUERIES_PER_BLOCK) or 1
    few = (asked_bytes or 0) <= broadcast_bytes
    n_slots = 1 if few else -(-source.count() // rows_per_slot) or 1
    asked_blocks = _packed(stored.withColumn("_b", F.pmod(F.xxhash64("_q"), F.lit(count))), ["_q", "_v"])
    asked_blocks = asked_blocks.select(F.col("_b").alias("_qb"), F.col("_blob").alias("_queries"), F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))).alias("_slot"))
    row_blocks = _packed_as_they_lie(source.select(*kept, F.col(vector)), n_slots)
    met = row_blocks.join(F.broadcast(asked_blocks) if few else asked_blocks, "_slot").select("_rows", "_queries", "_qb")

    schema = T.StructType([T.StructField(query_id, id_type), T.StructField("score", T.DoubleType()), *[source.schema[c] for c in kept]])
    best = met.mapInArrow(_searcher(k, id_col, vector, query_id, to_arrow_type(id_type), kept), schema)
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(id_col).asc())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _packed(df: DataFrame, columns: list[str], kind: str = "bigint") -> DataFrame:
    """One row per block ``_b``, whose size its hash bounds."""

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({"_b": pa.array([key[0].as_py()], pa.int64() if kind == "bigint" else pa.string()), "_blob": pa.array([_blob(table.select(columns))], pa.binary())})

    return df.groupBy("_b").applyInArrow(pack, f"_b {kind}, _blob binary")


def _packed_as_they_lie(df: DataFrame, slots: int) -> DataFrame:
    """Rows in blocks of a task's neighbours, dealt over the slots in turn; each task starts at another slot."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BLOCK):
                blob = _blob(pa.Table.from_batches([batch.slice(at, ROWS_PER_BLOCK)]))
                yield pa.RecordBatch.from_arrays([pa.array([n % slots], pa.int32()), pa.array([blob], pa.binary())], names=["_slot", "_rows"])
                n += 1

    return df.mapInArrow(pack, "_slot int, _rows binary")


def _first_of_ties(q: np.ndarray, r: np.ndarray, scores: np.ndarray, ids: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``k`` of the pairs per query, the best ones, and of equal scores those of the lowest ids, NULL first as in the final order.

    Without it a vector that many rows share would send all of them for each of its queries.
    """
    if not len(q) or np.bincount(q).max() <= k:
        return q, r
    places = np.empty(len(ids), np.int64)
    places[pc.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(ids))
    order = np.lexsort((places[r], -scores, q))
    q, r = q[order], r[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], r[kept]


def _searcher(k: int, id_col: str, vector: str, query_id: str, label_type: pa.DataType, kept: list[str]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[object, np.ndarray] = {}  # per query block: the k-th best score that this task has passed on
        for batch in batches:
            for i in range(batch.num_rows):
                rows, asked = (pa.ipc.open_stream(batch.column(c)[i].as_buffer()).read_all().combine_chunks() for c in (0, 1))
                if not rows.num_rows or not asked.num_rows:
                    continue
                queries = _unit_rows(_matrix(asked.column("_v").chunk(0)))
                scores = np.round(queries @ _unit_rows(_matrix(rows.column(vector).chunk(0))).T, SCORE_DIGITS)
                scores = np.where(np.isnan(scores), -np.inf, scores)
                floor = floors.setdefault(batch.column(2)[i].as_py(), np.full(len(queries), -np.inf))
                n = min(k, scores.shape[1])
                cut = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
                q, r = np.nonzero((scores >= np.maximum(cut, floor)[:, None]) & (scores > -np.inf))
                if scores.shape[1] >= k:
                    np.maximum(floor, cut, out=floor)
                q, r = _first_of_ties(q, r, scores[q, r], rows.column(id_col), k)
                if len(q):
                    labels = asked.column("_q").take(pa.array(q)).cast(label_type)
                    found = rows.select(kept).take(pa.array(r))
                    out = found.append_column(query_id, labels).append_column("score", pa.array(scores[q, r]))
                    yield from out.select([query_id, "score", *kept]).combine_chunks().to_batches()

    return search
