"""Text expressions: trimming, casing, component paths, header names, previews."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character the Unicode standard counts as white space, plus the four
# ASCII separators, as stripped from both ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Drop white space (Unicode, not only blanks) from both ends."""
    return F.btrim(_c(value), F.lit(WHITESPACE))


def is_all_caps(value: Column) -> Column:
    """True when there is at least one letter and no lower-case letter."""
    return (value == F.upper(value)) & (value != F.lower(value))


def title_case(value: Column | str) -> Column:
    """Capitalise after every non-letter, so ``ZYX-MOTORS`` gives ``Zyx-Motors``.

    ``initcap`` only looks at blanks and would give ``Zyx-motors``. Where plain letters and blanks are all there is, it gives the same, faster.
    """
    value = _c(value)
    runs = F.regexp_extract_all(F.lower(value), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    pieced = F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r)))), ""
    )
    return F.when(F.rlike(value, F.lit(r"\A[A-Za-z ]*\z")), F.initcap(value)).otherwise(pieced)


def _relaxed_caps(part: Column) -> Column:
    return F.when(part == F.upper(part), F.initcap(part)).otherwise(part)


def component_group(path: Column | str) -> Column:
    """Top level of a colon path; all-caps names are capitalised word by word."""
    return _relaxed_caps(F.trim(F.substring_index(_c(path), ":", 1)))


def component_leaf(path: Column | str) -> Column:
    """Last level of a colon path."""
    return _relaxed_caps(F.trim(F.substring_index(_c(path), ":", -1)))


def header_name(raw: str) -> str:
    """A feed header as a column name: lower case, ``[0-9a-z_]`` only, single underscores."""
    return re.sub(r"(?:_|[^0-9a-z])+", "_", raw.lower()).strip("_")


def header_name_col(raw: Column | str) -> Column:
    """Same rule as :func:`header_name`, for names held as data."""
    return F.btrim(F.regexp_replace(F.lower(_c(raw)), r"(?:_|[^0-9a-z])+", "_"), F.lit("_"))


def safe_file_part(raw: Column, default: str) -> Column:
    """Runs outside ``[A-Za-z0-9._-]`` become one underscore; empty falls back to ``default``."""
    return F.regexp_replace(F.coalesce(F.nullif(raw, F.lit("")), F.lit(default)), r"[^A-Za-z0-9._-]+", "_")


# A run of anything but WHITESPACE; spelled with the regex engine's own class, which is fast.
_WORD = r"(?U)[\S&&[^\x1c-\x1f]]+"


def word_count(value: Column | str) -> Column:
    """Number of white-space separated words; NULL and empty count 0."""
    return F.coalesce(F.regexp_count(_c(value), F.lit(_WORD)), F.lit(0))


def preview(value: Column | str, width: int) -> Column:
    return F.substring(_c(value), 1, width)


def truncate_with_marker(value: Column | str, width: int = 8000) -> Column:
    """Cut a payload at ``width`` characters and say how many were left out."""
    value = _c(value)
    cut = F.concat(
        F.substring(value, 1, width),
        F.lit("... [TRUNCATED "),
        (F.length(value) - F.lit(width)).cast("string"),
        F.lit(' chars — narrow your filters or lower num_results]"'),
    )
    return F.when(F.length(value) <= width, value).otherwise(cut)


_BLOCKS = r"(?is)<(script|style)\b[^>]*>.*?</(?:script|style)\s*>"
_COMMENTS = r"(?s)<!--.*?-->"
_TAGS = r"(?s)<[^>]*>"
# The character references decoded when a page becomes text.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_to_text(html: Column | str) -> Column:
    """Visible text of a page: scripts, styles, comments and tags out, blanks collapsed."""
    out = _c(html)
    for pattern in (_BLOCKS, _COMMENTS, _TAGS):
        out = F.regexp_replace(out, pattern, " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n\f]+", " "))
