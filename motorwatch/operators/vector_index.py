"""A stored vector index: coarse centroids with lists of rows, searched exactly.

Rows lie in the folder of the list whose centroid has the smallest angle to them; per list the smallest and largest such angle
are kept. Angles obey the triangle inequality: a row of a list is at least ``|angle(query, centroid) - angle(row, centroid)|``
away from a query. The lists nearest to a query that hold ``k`` rows are searched first, the k-th score found there is a floor, and of the
other lists only those are searched that may hold a row at or above the floor. The result is that of :func:`.vectors.top_k`,
whatever the centroids are; good centroids only make it read less. Lists that no query needs are not read at all.

Queries are copied to the lists they need, rows are not copied. A list of many rows is dealt over slots of ``ROWS_PER_SLOT`` when the index is
built, so a list with a third of all rows is many tasks. Centroids come from a bounded sample, every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import stage
from .vectors import FILTER_KEYS, QUERIES_PER_BLOCK, ROWS_PER_BLOCK, TOP_K, _blob, _matrix, _packed, _searcher, _unit_rows, metadata_filter

#: Rows that the centroids are learnt from, and the most lists.
SAMPLE = 16_384
MOST_LISTS = 1024
ROWS_PER_SLOT = 100_000
ROUNDS = 8
#: Angles are compared with this slack, far above rounding and far below what matters.
SLACK = 1e-7
#: Vectors that are compared with all centroids at a time.
VECTORS_PER_STEP = 256
LIST, SLOT, ANGLE = "_list", "_slot", "_angle"


@dataclass(frozen=True)
class VectorIndex:
    """Where an index lies and what it is made of."""

    path: str
    id_col: str
    vector: str
    schema: T.StructType

    def rows(self, spark: SparkSession) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField(SLOT, T.IntegerType()), T.StructField(LIST, T.IntegerType())])
        return spark.read.schema(full).parquet(f"{self.path}/rows")

    def lists(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/lists")


def learn_centroids(sample: np.ndarray, n_lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means; starts from evenly spaced rows of the sample."""
    units = _unit_rows(sample)
    units = units[~np.isnan(units).any(axis=1)]
    if not len(units):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    centers = units[np.linspace(0, len(units) - 1, min(n_lists, len(units))).astype(int)]
    for _ in range(rounds):
        nearest = np.argmax(units @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, units)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centers)
    return np.unique(centers, axis=0)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows each, as a row takes several numbers for every centroid."""
    for batch in batches:
        for at in range(0, batch.num_rows, VECTORS_PER_STEP):
            yield batch.slice(at, VECTORS_PER_STEP)


def build_index(
    corpus: DataFrame, path: str, *, id_col: str = "chunk_id", vector: str = "embedding", n_lists: int | None = None,
    sample: int = SAMPLE, rows_per_slot: int = ROWS_PER_SLOT,
) -> VectorIndex:
    """Writes ``rows`` (one folder per list) and ``lists`` under ``path``. Rows without a direction have no score and are left out."""
    spark = corpus.sparkSession
    source = corpus.where(F.col(vector).isNotNull())
    learnt = source.select(vector, F.xxhash64(F.col(id_col).cast("string")).alias("_h")).orderBy("_h").limit(sample)
    vectors = [r[vector] for r in learnt.collect()]
    wanted = n_lists or max(1, min(MOST_LISTS, round(source.count() ** 0.5)))
    centers = learn_centroids(np.array(vectors, dtype=np.float64), wanted) if vectors else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(centers)
    schema = T.StructType([*source.schema.fields, T.StructField(LIST, T.IntegerType()), T.StructField(ANGLE, T.DoubleType())])
    at = source.columns.index(vector)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            if len(shared.value):
                cosines = _unit_rows(_matrix(batch.column(at))) @ shared.value.T
                nearest = np.argmax(np.nan_to_num(cosines, nan=-2.0), axis=1)
                angles = np.arccos(np.clip(cosines[np.arange(len(nearest)), nearest], -1, 1))
                arrays = [*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(angles, from_pandas=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    placed = stage(source.mapInArrow(assign, schema).where(F.col(ANGLE).isNotNull()), "assigned")
    found = placed.groupBy(LIST).agg(F.count("*").alias("n"), F.min(ANGLE).alias("near"), F.max(ANGLE).alias("far"))
    slots = F.ceil(F.col("n") / rows_per_slot).cast("int")
    # At most ``MOST_LISTS`` rows from here on.
    stats = {r[LIST]: r for r in found.withColumn("slots", slots).collect()}
    listed = [(i, centers[i].tolist(), r["n"], r["near"], r["far"], r["slots"]) for i, r in sorted(stats.items())]
    lists = spark.createDataFrame(listed, f"{LIST} int, center array<double>, n bigint, near double, far double, slots int")
    lists.write.parquet(f"{path}/lists")
    dealt = placed.join(F.broadcast(lists.select(LIST, "slots")), LIST)
    dealt = dealt.withColumn(SLOT, F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.col("slots")).cast("int")).drop("slots", ANGLE)
    dealt.repartition(LIST, SLOT).sortWithinPartitions(LIST, SLOT).write.partitionBy(LIST).parquet(f"{path}/rows")
    return VectorIndex(path, id_col, vector, source.schema)


class Lists:
    """The lists of an index in memory: at most ``MOST_LISTS``."""

    def __init__(self, rows: list):
        self.ids = np.array([r[LIST] for r in rows], np.int64)
        self.centers = np.array([r["center"] for r in rows], np.float64) if rows else np.zeros((0, 0))
        self.n, self.near, self.far = (np.array([r[c] for r in rows], np.float64) for c in ("n", "near", "far"))

    def angles(self, queries: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(_unit_rows(queries) @ self.centers.T, -1, 1))

    def first(self, angles: np.ndarray, k: int) -> np.ndarray:
        """The nearest lists of each query that hold ``k`` rows together."""
        order = np.argsort(angles, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        chosen = np.zeros(angles.shape, bool)
        np.put_along_axis(chosen, order, before < k, axis=1)
        return chosen

    def possible(self, angles: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """Lists that may hold a row with a score of at least the floor."""
        least = np.maximum(0, np.maximum(angles - self.far, self.near - angles) - SLACK)
        return np.cos(least) + SLACK >= floors[:, None]


def _pairs(asked: DataFrame, lists: Lists, k: int, later: bool) -> DataFrame:
    """``(_q, _v, _list)``: the lists to be searched for each query, first or, with the column ``_floor``, later."""
    shared = asked.sparkSession.sparkContext.broadcast(lists)
    schema = T.StructType([asked.schema["_q"], asked.schema["_v"], T.StructField(LIST, T.IntegerType())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in _steps(batches):
            if not len(known.ids):
                continue
            angles = known.angles(_matrix(batch.column(1)))
            chosen = known.first(angles, k)
            if later:
                chosen = ~chosen & known.possible(angles, batch.column(2).to_numpy(zero_copy_only=False))
            q, at = np.nonzero(chosen & ~np.isnan(angles))
            taken = batch.select([0, 1]).take(pa.array(q))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(known.ids[at].astype(np.int32))], names=schema.names)

    return asked.mapInArrow(choose, schema)


def _search(index: VectorIndex, pairs: DataFrame, rows: DataFrame, slots: DataFrame, k: int, query_id: str, kept: list[str]) -> DataFrame:
    """Hits of the pairs: blocks of queries meet blocks of rows of the same list and slot."""
    pairs = stage(pairs, "probes")
    sizes = pairs.groupBy(LIST).agg(F.ceil(F.count("*") / QUERIES_PER_BLOCK).alias("_blocks"))
    needed = [r[LIST] for r in sizes.select(LIST).collect()]  # at most ``MOST_LISTS``
    id_type = pairs.schema["_q"].dataType
    schema = T.StructType([T.StructField(query_id, id_type), T.StructField("score", T.DoubleType()), *[rows.schema[c] for c in kept]])
    if not needed:
        return pairs.sparkSession.createDataFrame([], schema)
    block = F.concat_ws("/", LIST, F.pmod(F.xxhash64("_q"), F.col("_blocks")))
    packed = _packed(pairs.join(F.broadcast(sizes), LIST).withColumn("_b", block), ["_q", "_v"], "string")
    asked = packed.withColumn(LIST, F.split("_b", "/")[0].cast("int")).join(F.broadcast(slots), LIST)
    each = F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias(SLOT)
    asked = asked.select(LIST, F.col("_b").alias("_qb"), F.col("_blob").alias("_queries"), each)
    source = rows.where(F.col(LIST).isin(needed)).select(LIST, SLOT, *kept, index.vector)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, dealt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(lists) != 0) | (np.diff(dealt) != 0)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                for at in range(start, stop, ROWS_PER_BLOCK):
                    part = batch.slice(at, min(ROWS_PER_BLOCK, stop - at))
                    blob = _blob(pa.Table.from_batches([part.select(list(range(2, batch.num_columns)))]))
                    arrays = [part.column(0).slice(0, 1), part.column(1).slice(0, 1), pa.array([blob], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=[LIST, SLOT, "_rows"])

    blocks = source.mapInArrow(pack, f"{LIST} int, {SLOT} int, _rows binary")
    met = blocks.join(asked, [LIST, SLOT]).select("_rows", "_queries", "_qb")
    return met.mapInArrow(_searcher(k, index.id_col, index.vector, query_id, to_arrow_type(id_type), kept), schema)


def search_index(
    spark: SparkSession, index: VectorIndex, queries: DataFrame, *, k: int = TOP_K, query_id: str = "query_id", query_vector: str = "query_vector",
    columns: Sequence[str] = (), filters: Mapping[str, object] | None = None, allowed: frozenset[str] = FILTER_KEYS,
) -> DataFrame:
    """The ``k`` rows with the highest cosine per query, as :func:`.vectors.top_k` finds them; query ids must be unique."""
    kept = [index.id_col, *columns]
    lists = index.lists(spark)
    known = Lists(lists.orderBy(LIST).collect())
    rows = index.rows(spark).where(metadata_filter(filters, allowed))
    slots = lists.select(LIST, "slots")
    asked = stage(queries.select(F.col(query_id).alias("_q"), F.col(query_vector).alias("_v")).where("_v IS NOT NULL"), "asked")
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(index.id_col).asc())

    def best(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = stage(best(_search(index, _pairs(asked, known, k, False), rows, slots, k, query_id, kept)), "first-hits")
    floors = first.where(F.col("rank") == k).select(F.col(query_id).alias("_q"), F.col("score").alias("_floor"))
    open_ = asked.join(floors, "_q", "left").select("_q", "_v", F.coalesce("_floor", F.lit(-2.0)).alias("_floor"))
    more = _search(index, _pairs(open_, known, k, True), rows, slots, k, query_id, kept)
    return best(first.drop("rank").unionByName(more))
