"""Connected components of a graph given as edges, by stars that alternate between large and small neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of an edge.

    Each round replaces edges by edges to the smallest neighbour; sums per node combine before the shuffle, and
    the number of edges never grows. Rounds grow with the logarithm of the longest path. Every round is a written table.
    """
    current = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        current = stage(small.where("u > v").distinct(), "edges")
        before, state = state, _state(current)
        if state == before:
            break
    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), "v"))).alias("e")
    return current.select(ends).select(F.col("e.u").alias("node"), F.col("e.v").alias("component")).distinct()


def _state(edges: DataFrame) -> tuple:
    """Tells sets of edges apart: stars, which a round leaves as they are, have the state of the round before."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
