"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at one measure of a text and votes good (1), bad (0) or abstains (-1). Expectation-maximisation estimates,
without labels, how often each rule gives each vote on good and on bad documents; the posterior probability that a
document is good replaces the rule that all filters must pass. Votes are counted per pattern, with map-side
combine: at most 3^10 patterns exist however many documents there are, all documents count, and only these counts
reach the driver. The posterior is then a column expression, a sum of log odds.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Windows of eight words are compared by 64-bit hashes inside their own text; two different windows
of a text of 20,000 words collide with a probability of about 1e-11.

Defined results: a NULL or empty text has no words, all measures 0, and fails the base rules; repeated documents vote each
and get equal results; with no documents at all the prior is one half and nothing is returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_row

WINDOW = 8
ROUNDS = 50
KEEP_AT = 0.5
#: Frequent short function words of four languages; a text in one of them holds several.
FUNCTION_WORDS = (
    "the of and to in is for with that on are as be this der die und das von zu den ein mit ist de la le les et des du en "
    "que un el los se con por una para"
).split()

#: Rule: (measure, votes bad, votes good) as SQL over the measures; neither true means abstain.
RULES = {
    "symbols": ("n_symbols > 0.3 * n_words", "n_symbols <= 0.1 * n_words"),
    "capitals": ("n_capitals > 0.5 * n_words", "n_capitals <= 0.1 * n_words"),
    "shouts": ("n_shouts > 0.3 * n_words", "n_shouts <= 0.05 * n_words"),
    "bare_marks": ("n_bare > 0.2 * n_words", "n_bare <= 0.05 * n_words"),
    "repeated_lines": ("n_dup_lines > 0.3 * n_lines", "n_lines >= 3 and n_dup_lines = 0"),
    "repeated_words": ("n_repeat_words > 0.2 * n_words", "n_repeat_words <= 0.05 * n_words"),
    "word_length": ("word_chars < 3 * n_words or word_chars > 12 * n_words", "word_chars between 3.5 * n_words and 9 * n_words"),
    "function_words": ("n_function < 0.02 * n_words", "n_function >= 0.08 * n_words"),
    "line_ends": ("n_line_ends < 0.1 * n_lines", "n_line_ends >= 0.6 * n_lines"),
    "length": ("n_words < 25", "n_words >= 60"),
}


def _let(value: str, body: str) -> str:
    """``body`` with ``it`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), it -> {body})[0]"


def repeated_words(hashes: str, n: str, width: int = WINDOW) -> str:
    """SQL: words inside windows that occur twice or more, from the array of word hashes and its size."""
    window = ", ".join(f"it[i + {k}]" if k else "it[i]" for k in range(width))
    windows = _let(hashes, f"transform(sequence(0, {n} - {width}), i -> xxhash64({window}))")
    same = "coalesce(get(it, j {} 1).h = x.h, false)"
    ordered = "array_sort(transform(it, (h, i) -> struct(h as h, i as i)))"
    positions = _let(ordered, f"array_sort(transform(filter(it, (x, j) -> {same.format('-')} or {same.format('+')}), x -> x.i))")
    covered = _let(positions, f"aggregate(it, struct(0 as n, -{width} as p), (a, x) -> struct(a.n + least({width}, x - a.p) as n, x as p), a -> a.n)")
    total = _let(windows, f"if(size(it) > size(array_distinct(it)), {covered}, 0)")
    return f"cast(if({n} > {width}, {total}, 0) as bigint)"


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the document) and what the rules look at."""
    t = F.coalesce(docs[text], F.lit(""))
    words = F.regexp_extract_all(t, F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    listed = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
    first = docs.select(
        whole_row(docs).alias("row"), words.alias("w"), lines.alias("l"),
        F.length(F.regexp_replace(t, "[\\x20\\x09-\\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit("\\p{Lu}{2}")).alias("n_capitals"),
        F.regexp_count(t, F.lit("!!")).alias("n_shouts"),
        F.regexp_count(t, F.lit("(?<![^\\x20\\x09-\\x0D])[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+(?![^\\x20\\x09-\\x0D])")).alias("n_bare"),
        F.regexp_count(t, F.lit("[.!?]\\x20*(\\n|$)")).alias("n_line_ends"),
    )
    second = first.select(
        "row", "word_chars", "n_symbols", "n_capitals", "n_shouts", "n_bare", "n_line_ends",
        F.size("w").cast("long").alias("n_words"), F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr(f"size(filter(w, x -> lower(x) in ({listed})))").alias("n_function"),
        F.expr("transform(w, x -> xxhash64(x))").alias("hw"), F.size("w").alias("n"),
    )
    return second.withColumn("n_repeat_words", F.expr(repeated_words("hw", "n"))).drop("hw", "n")


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


def votes(rules: dict[str, tuple[str, str]] = RULES) -> Column:
    """The votes of one document as a string of ``0``, ``1`` and ``-``."""
    return F.concat(*[F.when(F.expr(bad), "0").when(F.expr(good), "1").otherwise("-") for bad, good in rules.values()])


def estimate(patterns: list[tuple[str, int]], rounds: int = ROUNDS) -> tuple[float, list[dict[str, tuple[float, float]]]]:
    """Prior of good, and for each rule and vote its probability on (bad, good) documents.

    Starts from the majority of the votes cast; counts are smoothed by one, so nothing is impossible.
    """
    if not patterns:
        return 0.5, []
    n_rules = len(patterns[0][0])
    good = [(p.count("1") + 1) / (p.count("1") + p.count("0") * 2 + 2) for p, _ in patterns]
    prior, tables = 0.5, []
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        mass = sum(g * n for g, (_, n) in zip(good, patterns, strict=True))
        prior = (mass + 1) / (total + 2)
        tables = []
        for r in range(n_rules):
            sums = {v: [1.0, 1.0] for v in "01-"}
            for g, (p, n) in zip(good, patterns, strict=True):
                sums[p[r]][0] += (1 - g) * n
                sums[p[r]][1] += g * n
            ends = [sum(s[k] for s in sums.values()) for k in (0, 1)]
            tables.append({v: (s[0] / ends[0], s[1] / ends[1]) for v, s in sums.items()})
        good = [posterior(prior, tables, p) for p, _ in patterns]
    return prior, tables


def posterior(prior: float, tables: list[dict[str, tuple[float, float]]], pattern: str) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(t[v][1] / t[v][0]) for t, v in zip(tables, pattern, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def log_odds(prior: float, tables: list[dict[str, tuple[float, float]]], pattern: Column) -> Column:
    """The posterior's log odds as a column over patterns."""
    total = F.lit(math.log(prior / (1 - prior)))
    for at, t in enumerate(tables, 1):
        vote, weight = F.substring(pattern, at, 1), {v: F.lit(math.log(g / b)) for v, (b, g) in t.items()}
        total = total + F.when(vote == "1", weight["1"]).when(vote == "0", weight["0"]).otherwise(weight["-"])
    return total


def judge(docs: DataFrame, text: str = "text", keep_at: float = KEEP_AT, rounds: int = ROUNDS) -> DataFrame:
    """``row``, the measures, ``votes``, ``quality`` (posterior of good), ``base_failed`` and ``kept``.

    The documents are measured twice, once to count vote patterns and once for the result: a written copy of the
    measures would be read back once as well, and this way nothing is stored.
    """
    judged = measures(docs, text).withColumn("votes", votes())
    counted = judged.groupBy("votes").count().collect()  # at most 3^rules rows
    prior, tables = estimate(sorted((r["votes"], r["count"]) for r in counted), rounds)
    odds = log_odds(prior, tables, F.col("votes"))
    return (
        judged.withColumn("quality", 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), odds)))))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at))
    )
