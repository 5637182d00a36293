"""Answer scoring as column expressions over an answers table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, word_count

# Pass marks.
LIST_COVERAGE_MIN = 0.8
JUDGE_MIN = 4.0
RUBRIC_MIN = 3.5
MAX_WORDS = 400
PENDING_PREFIX = "TBD:"

# Fixed value: shapes of a cited source id (recall campaign, child seats included; investigation, with
# and without a hyphen; bulletin; complaint; bare eight digits).
CITE_ID = (
    r"(?i)(?:"
    r"\b\d{2}[VEITC]-?\d{3,}-?\d*\b"
    r"|\b(?:PE|EA|DP|RQ|AQ)\d{2}-?\d{3}\b"
    r"|\bTSB[- #]*\d{6,}\b"
    r"|\bODI(?:[- ]?ID)?[- #]*\d{6,}\b"
    r"|\b\d{8}\b"
    r")"
)

# Manufacturer names looked for in answers.
OEM_KEYWORDS = (
    "Tesla", "Ford", "General Motors", "Chevrolet", "GMC", "Cadillac", "Toyota", "Lexus", "Honda",
    "Acura", "Nissan", "Infiniti", "Hyundai", "Kia", "Genesis", "BMW", "Mercedes-Benz", "Audi",
    "Volkswagen", "Porsche", "Stellantis", "Jeep", "Ram", "Dodge", "Chrysler", "Subaru", "Mazda",
    "Volvo", "Rivian", "Lucid", "Polestar", "Cruise", "Waymo", "Zoox",
)


def _text(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(value, F.lit(""))


def _as_score(passed: Column) -> Column:
    return F.when(passed, F.lit(1.0)).otherwise(F.lit(0.0))


def score_exact(expected: Column | str, answer: Column | str) -> Column:
    """1.0 or 0.0 against a known value.

    A ``|`` in the expected value makes it a list: at least 80 % of its items must occur in
    the answer. A pure number must equal the first number in the answer. Anything else must
    occur in the answer. Case never matters.
    """
    want, got = strip(_text(expected)), F.lower(_text(answer))

    items = F.filter(F.transform(F.split(F.lower(want), r"\|"), strip), lambda item: item != "")
    found = F.filter(items, lambda item: F.contains(got, item))
    listed = F.size(found) / F.greatest(F.size(items), F.lit(1)) >= LIST_COVERAGE_MIN

    first_number = F.regexp_extract(_text(answer), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    numeric = F.coalesce(F.abs(first_number - want.try_cast("double")) < 1e-6, F.lit(False))

    return (
        F.when(F.contains(want, F.lit("|")), _as_score(listed))
        .when(want.rlike(r"\A-?\d+(?:\.\d+)?\z"), _as_score(numeric))
        .otherwise(_as_score((want != "") & F.contains(got, F.lower(want))))
    )


def exact_breakdown(expected: Column | str, answer: Column | str) -> Column:
    """Why :func:`score_exact` decided as it did: ``struct(kind, coverage, found, missing)``.

    ``kind`` is list, number or text; ``found`` and ``missing`` hold a list's items, or the expected
    value itself, and ``coverage`` is the share found.
    """
    want, got = strip(_text(expected)), F.lower(_text(answer))
    items = F.filter(F.transform(F.split(F.lower(want), r"\|"), strip), lambda item: item != "")
    listed = F.contains(want, F.lit("|"))
    kind = F.when(listed, "list").when(want.rlike(r"\A-?\d+(?:\.\d+)?\z"), "number").otherwise("text")
    hit = score_exact(expected, answer) == 1.0
    none, alone = F.array().cast("array<string>"), F.array(want)
    found = F.when(listed, F.filter(items, lambda item: F.contains(got, item))).when(hit, alone).otherwise(none)
    missing = F.when(listed, F.filter(items, lambda item: ~F.contains(got, item))).when(hit, none).otherwise(alone)
    share = F.size(found) / F.greatest(F.size(found) + F.size(missing), F.lit(1))
    return F.struct(kind.alias("kind"), share.alias("coverage"), found.alias("found"), missing.alias("missing"))


def _squash(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"[^a-z0-9]", "")


def cite_match(source_id: Column | str, answer: Column | str) -> Column:
    """The id occurs in the answer once punctuation is ignored; six or more bare digits also do."""
    source, squashed = _text(source_id), _squash(_text(answer))
    digits = F.regexp_replace(source, r"\D", "")
    return (source != "") & (
        F.contains(squashed, _squash(source)) | ((F.length(digits) >= 6) & F.contains(squashed, digits))
    )


def score_grounded(source_id: Column | str, answer: Column | str, judge: Column | None = None) -> Column:
    """1.0 when the source is cited and the judge gave at least 4; without a judge the citation decides."""
    cited = cite_match(source_id, answer)
    if judge is None:
        return _as_score(cited)
    return _as_score(cited & (F.coalesce(judge.cast("double"), F.lit(0.0)) >= JUDGE_MIN))


def score_rubric(parts: list[Column], overall: Column | None = None) -> Column:
    """Mean of the rubric parts; when all are zero or missing, the overall score if there is one."""
    values = [F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts]
    total = reduce(lambda a, b: a + b, values)
    mean = total / F.lit(float(len(values)))
    return mean if overall is None else F.when(total == 0.0, F.coalesce(overall.cast("double"), mean)).otherwise(mean)


def rubric_passed(score: Column) -> Column:
    return score >= RUBRIC_MIN


def cite_id_present(answer: Column | str) -> Column:
    """A source id is cited. Every shape holds three digits in a row, so that is looked for first."""
    return _text(answer).rlike(r"\d{3}") & _text(answer).rlike(CITE_ID)


def word_count_under(answer: Column | str, limit: int = MAX_WORDS) -> Column:
    return word_count(_text(answer)) <= limit


def mentions_any(answer: Column | str, keywords: tuple[str, ...] = OEM_KEYWORDS) -> Column:
    """Any keyword occurs, as a plain case-insensitive substring ("ram" is also in "frame").

    A chain of ``contains`` stops at the first hit and stays in generated code.
    """
    low = F.lower(_text(answer))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(k.lower())) for k in keywords])


def is_pending(expected: Column | str) -> Column:
    return F.startswith(_text(expected), F.lit(PENDING_PREFIX))


def triage_bucket(cite_ok: Column, judge: Column, source_id: Column | str, answer: Column | str) -> Column:
    """Why a grounded answer failed.

    A: cited in another form. B: not cited. C: cited but judged below 4. D: cited, no judge score.
    """
    digits = F.regexp_replace(_text(source_id), r"\D", "")
    other_form = (digits != "") & F.contains(_squash(_text(answer)), digits)
    return (
        F.when(cite_ok.eqNullSafe(F.lit(False)), F.when(other_form, F.lit("A")).otherwise(F.lit("B")))
        .when(cite_ok & judge.isNull(), F.lit("D"))
        .when(cite_ok & (judge < JUDGE_MIN), F.lit("C"))
        .otherwise(F.lit("other"))
    )


def retrieved_context(trace: Column) -> Column:
    """``[name] preview`` per tool call, one per line, from an array of (name, result_preview)."""
    lines = F.transform(
        trace, lambda t: F.concat(F.lit("["), t["name"], F.lit("] "), F.coalesce(t["result_preview"], F.lit("")))
    )
    return F.array_join(lines, "\n")
