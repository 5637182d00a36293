"""Lenient typing of all-text feeds: a bad value becomes NULL, never a failed job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# What a cast of text to a whole number takes: digits, a sign, and blanks or control characters around them. A cast that fails costs
# as much as many that do not, as it goes through an exception; other texts are passed over without one.
_INTEGER = r"\A[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*\z"


def _whole(value: Column | str, kind: str) -> Column:
    return F.when(F.rlike(_c(value), F.lit(_INTEGER)), _c(value).try_cast(kind))


def lenient_int(value: Column | str) -> Column:
    return _whole(value, "int")


def lenient_long(value: Column | str) -> Column:
    return _whole(value, "bigint")


def yes_flag(value: Column | str) -> Column:
    """``Y``/``y`` is true; everything else, NULL included, is false."""
    return F.coalesce(F.upper(_c(value)) == F.lit("Y"), F.lit(False))


# Fixed value: earliest date taken as real.
EARLIEST = "1950-01-01"
# Eight digits with a month and a day that some month has; what else is no date is left to the parser.
_COMPACT = r"\A[0-9]{4}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])\z"


def compact_date(value: Column | str, as_of: Column | None = None) -> Column:
    """``yyyyMMdd`` text as a date, NULL outside [1950-01-01, ``as_of`` + one year].

    Digit slips such as year 3 or year 2203 parse as dates; the clamp keeps them out. Texts of another shape never reach a parser,
    whose failures are slow.
    """
    as_of = F.current_date() if as_of is None else as_of
    text = _c(value)
    parsed = F.when(F.rlike(text, F.lit(_COMPACT)), F.try_to_date(text, "yyyyMMdd"))
    return F.when(parsed.between(F.lit(EARLIEST).cast("date"), F.add_months(as_of, 12)), parsed)


# The date shapes met in crash snapshots, tried in this order, and what a text must look like to be tried.
CRASH_DATE_FORMATS = {
    "yyyy-MM-dd": r"\A[+-]?[0-9]{4,}-[0-9]{2}-[0-9]{2}\z",
    "MM/dd/yyyy": r"\A[0-9]{2}/[0-9]{2}/[+-]?[0-9]{4,}\z",
    "MMM-yyyy": r"\A[^0-9+-]{3,}-[+-]?[0-9]{4,}\z",
}


def any_date(value: Column | str) -> Column:
    """First date shape that parses; unknown shapes give NULL."""
    value = _c(value)
    tries = [F.when(F.rlike(value.cast("string"), F.lit(shape)), F.try_to_date(value, fmt)) for fmt, shape in CRASH_DATE_FORMATS.items()]
    return F.coalesce(*tries, F.try_to_date(value))


def automation_level(value: Column | str) -> Column:
    """``L`` and the first digit; no digit gives plain ``L``, NULL stays NULL."""
    return F.concat(F.lit("L"), F.regexp_extract(_c(value), r"\d", 0))
