"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

A source with share p of all tokens gets the weight p^a, normalised. The exponent a lies between 0 (all sources alike)
and 1 (as they come), in steps of a millionth. Two conditions can be given:

* ``target_entropy``: the largest exponent whose weights have at least this entropy, as a share of the logarithm of the number of sources;
* ``max_repeats``: no source may be read more often than this; where both are in force and disagree, this one wins.

Without an entropy the smallest exponent that keeps the limit is taken, the flattest mixture it allows. Where even a = 1
breaks it, because the budget is that large, a is 1. Both conditions are monotone in a, so the interval is cut into a
hundred parts, three times; the sums for all cut points are one aggregate over the table of sources, which is never collected.

Weights are rounded to billionths and turn the budget into whole tokens per source. A source is read in passes. Its documents are
dealt into blocks of about ``block_tokens`` by hash; a pass reads the blocks in an order of its own and the last pass stops
when the budget is met. So only sums of blocks are ordered per source, and a source with a third of all rows
is many blocks. ``position`` (tokens read before, as a share of the source's budget) interleaves the sources evenly.

Defined results: NULL sources are one source; documents without tokens take part in each full pass, and in the last while it lasts;
a repeated row is a document of its own; a source without tokens has weight 0 and no rows; no documents give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import whole_row

STEPS = 1_000_000
PER_ROUND = 100
BLOCK_TOKENS = 1 << 20
MAX_REPEATS = 2.0
PPB = 1_000_000_000


def word_count(text: Column) -> Column:
    """Runs of characters that are not ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def draw(*parts: Column) -> Column:
    """48 bits of MD5 over the parts, joined by '|' (NULL reads as nothing)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def exponent(sources: DataFrame, budget: int, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS) -> int:
    """The exponent in millionths for a table with the ``tokens`` of each source."""
    total, n = sources.where("tokens > 0").agg(F.sum("tokens"), F.count("*")).first()
    if not total:
        return STEPS
    shares = sources.where("tokens > 0").select((F.col("tokens") / F.lit(float(total))).alias("p"))

    def sums(points: list[int]) -> list[tuple[float, float, float]]:
        cells = []
        for a in (point / STEPS for point in points):
            power = F.pow("p", F.lit(a))
            cells.append(F.array(F.sum(power), F.sum(power * F.log("p")), F.pow(F.min("p"), F.lit(a - 1))))
        return shares.agg(F.array(*cells)).first()[0]

    def first_true(holds) -> int:
        """Smallest exponent that ``holds``, which at the upper end is taken for granted."""
        low, high = -1, STEPS
        while high - low > 1:
            step = max(1, (high - low) // PER_ROUND)
            points = [p for p in range(low + step, high, step)]
            true = [p for p, (z, s, least) in zip(points, sums(points), strict=True) if holds(p / STEPS, z, s, least)]
            high = min(true, default=high)
            low = max([low, *(p for p in points if p < high)])
        return high

    least = first_true(lambda a, z, s, ratio: ratio / z * (budget / total) <= max_repeats)
    if target_entropy is None or n < 2:
        return least
    wanted = target_entropy * math.log(n)
    over = first_true(lambda a, z, s, ratio: math.log(z) - a * s / z < wanted)
    at_end = sums([STEPS])[0]
    highest = STEPS if over == STEPS and math.log(at_end[0]) - at_end[1] / at_end[0] >= wanted else over - 1
    return max(highest, least)


def targets(sources: DataFrame, exponent_ppm: int, budget: int) -> DataFrame:
    """``weight_ppb`` and ``target`` (tokens to read) next to each source."""
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(exponent_ppm / STEPS))).otherwise(0.0)
    powers = sources.withColumn("power", power)
    z = powers.agg(F.sum("power")).first()[0] or 1.0
    ppb = F.round(F.col("power") / F.lit(z) * PPB).cast("long")
    exact = F.expr(f"cast(weight_ppb as decimal(20,0)) * {budget} div {PPB}")
    return powers.withColumn("weight_ppb", ppb).withColumn("target", exact.cast("long")).drop("power")


def mix(
    docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", tokens: Column | None = None,
    budget: int | None = None, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS,
    block_tokens: int = BLOCK_TOKENS, seed: int = 7,
) -> DataFrame:
    """``row`` (the document), ``n_tokens``, ``pass_no``, ``block``, ``position``, ``weight_ppb`` for each reading of a document.

    The budget is that of all documents read once, unless given.
    """
    key = F.when(docs[source].isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), docs[source].cast("string")))
    count = word_count(docs[text]) if tokens is None else tokens
    tie = draw(F.lit(seed), docs[doc_id])
    given = docs.select(
        whole_row(docs).alias("row"), key.alias("key"), count.alias("n_tokens"),
        tie.alias("draw"), F.coalesce(docs[doc_id].cast("string"), F.lit("")).alias("id"),
        F.md5(F.coalesce(docs[text], F.lit("")).cast("binary")).alias("digest"),
    )
    sources = stage(given.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    plan = targets(sources, exponent(sources, budget, target_entropy, max_repeats), budget)
    n_blocks = F.expr(f"(tokens + docs + {block_tokens - 1}) div {block_tokens}")
    plan = stage(plan.where("target > 0").withColumn("n_blocks", n_blocks), "plan")

    dealt = given.join(plan.select("key", "n_blocks"), "key").withColumn("block", F.col("draw") % F.col("n_blocks"))
    inside = Window.partitionBy("key", "block").orderBy("draw", "id", "n_tokens", "digest")
    placed = dealt.withColumn(
        "before", F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    # Sums per block, which combine before the shuffle; then one small row per block and pass.
    blocks = given.join(plan.select("key", "n_blocks"), "key").groupBy("key", (F.col("draw") % F.col("n_blocks")).alias("block"))
    passes = blocks.agg(F.sum("n_tokens").alias("block_tokens")).join(plan, "key")
    passes = passes.withColumn("pass_no", F.explode(F.expr("sequence(0L, (target - 1) div tokens)")))
    order = Window.partitionBy("key", "pass_no").orderBy(draw(F.lit(seed), F.col("key"), F.col("pass_no"), F.col("block")), "block")
    ahead = F.coalesce(F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = passes.withColumn("block_start", F.col("pass_no") * F.col("tokens") + ahead).where("block_start < target")
    starts = starts.groupBy("key", "block", "target", "weight_ppb").agg(
        F.array_sort(F.collect_list(F.struct("pass_no", "block_start"))).alias("reads")
    )
    read = placed.join(starts, ["key", "block"]).withColumn("read", F.explode("reads"))
    at = F.col("read.block_start") + F.col("before")
    return read.where(at < F.col("target")).select(
        "row", "n_tokens", F.col("read.pass_no").alias("pass_no"), "block", (at / F.col("target")).alias("position"), "weight_ppb"
    )
