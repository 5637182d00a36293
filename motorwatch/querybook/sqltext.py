"""SQL fragments for the checks, written for DuckDB independently of the Spark expressions."""

from __future__ import annotations

from ..sources.taxonomy import ALIASES, MAKES_BY_GROUP
from . import feeds


def literal(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '')"


def initcap(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def component(x: str, part: int) -> str:
    h = f"trim(split_part({x}, ':', {part}))"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {h} = upper({h}) THEN {initcap(h)} ELSE {h} END"


def clamped(x: str, as_of: str = feeds.AS_OF) -> str:
    d = f"try_strptime({x}, '%Y%m%d')::DATE"
    return (
        f"CASE WHEN {d} BETWEEN DATE '1950-01-01' AND (DATE '{as_of}' + INTERVAL 1 YEAR)::DATE THEN {d} END"
    )


def _names() -> str:
    rows = [(m.upper(), None, g) for g, makes in MAKES_BY_GROUP.items() for m in makes if m.upper() not in ALIASES]
    group = {m: g for g, makes in MAKES_BY_GROUP.items() for m in makes}
    rows += [(a, m, group[m]) for a, m in ALIASES.items()]
    return ", ".join(f"({literal(n)}, {literal(a)}, {literal(g)})" for n, a, g in rows)


NAMES = f"names(name, alias_of, grp) AS (VALUES {_names()})"


def make_norm(x: str) -> str:
    n = f"trim({x})"
    tidy = f"CASE WHEN {n} = upper({n}) AND {n} <> lower({n}) THEN {title(n)} ELSE {n} END"
    return f"CASE WHEN {x} <> '' THEN coalesce(alias_of, {tidy}) END"


def oem_group(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN grp END"


def with_names(source: str, make: str = "maketxt") -> str:
    return f"{source} LEFT JOIN names ON upper(trim({make})) = name"


YEAR = "TRY_CAST(yeartxt AS INTEGER)"
# '2004.0' casts to 2004 in DuckDB but is no integer text; only digits count.
INT_YEAR = "CASE WHEN regexp_full_match(trim(yeartxt), '[0-9]+') THEN trim(yeartxt)::INTEGER END"

TYPED_RECALLS = f"""{feeds.SQL_RAW_RECALLS}, {NAMES}, recalls AS (
  SELECT record_id, campno AS campaign_number, {make_norm('maketxt')} AS make_norm, {oem_group('maketxt')} AS oem_group,
    modeltxt AS model_norm, {INT_YEAR} AS model_year, compname AS component_raw,
    {component('compname', 1)} AS component_group, {component('compname', -1)} AS component_leaf,
    rcltypecd AS recall_type_code, potaff::BIGINT AS units_affected, {clamped('odate')} AS event_date,
    {clamped('rcdate')} AS record_creation_date, fmvss, desc_defect AS defect_description
  FROM {with_names('raw_recalls')})"""

TYPED_INVESTIGATIONS = f"""{feeds.SQL_RAW_INVESTIGATIONS}, {NAMES}, dated AS (
  SELECT *, {clamped('action_open_date')} AS open_date, {clamped('action_close_date')} AS close_date
  FROM {with_names('raw_investigations')}), investigations AS (
  SELECT nhtsa_action_number, substring(nhtsa_action_number, 1, 2) AS investigation_type, subject,
    {make_norm('maketxt')} AS mfr_norm, {oem_group('maketxt')} AS oem_group, modeltxt AS model_norm, {INT_YEAR} AS model_year,
    component_name AS component_raw, {component('component_name', 1)} AS component_group, open_date, close_date,
    date_diff('day', open_date, coalesce(close_date, DATE '{feeds.AS_OF}'))::INTEGER AS days_open,
    CASE WHEN close_date IS NULL THEN 'open' ELSE 'closed' END AS status
  FROM dated)"""

TYPED_BULLETINS = f"""{feeds.SQL_RAW_BULLETINS}, {NAMES}, bulletins AS (
  SELECT tsb_id, nhtsa_item_number, {make_norm('maketxt')} AS make_norm, {oem_group('maketxt')} AS oem_group,
    modeltxt AS model_norm, {INT_YEAR} AS model_year, component_desc AS component_raw,
    {component('component_desc', 1)} AS component_group, summary, {clamped('orig_date')} AS original_date,
    year({clamped('orig_date')})::INTEGER AS bulletin_year
  FROM {with_names('raw_bulletins')})"""

_COMPLAINT_COLUMNS = f"""cmplid AS complaint_id, odino AS odi_number, {make_norm('maketxt')} AS make_norm,
    {oem_group('maketxt')} AS oem_group, modeltxt AS model_norm, {INT_YEAR} AS model_year,
    {component('compdesc', 1)} AS component_group, {component('compdesc', -1)} AS component_leaf,
    {clamped('faildate')} AS incident_date, coalesce(upper(crash) = 'Y', FALSE) AS crash,
    coalesce(upper(fire) = 'Y', FALSE) AS fire, TRY_CAST(injured AS INTEGER) AS injured,
    TRY_CAST(deaths AS INTEGER) AS deaths, TRY_CAST(miles AS BIGINT) AS miles, city, state,
    length(cdescr)::INTEGER AS narrative_len_orig"""

TYPED_COMPLAINTS = f"""{feeds.SQL_RAW_COMPLAINTS}, {NAMES}, complaints AS (
  SELECT {_COMPLAINT_COLUMNS}, cdescr FROM {with_names('raw_complaints')})"""

# Any 17 letters and digits of a vehicle number, at least one of them a digit, one branch per
# position of the first digit, as there is no look-ahead here.
_L, _A = "[A-HJ-NPR-Z]", "[A-HJ-NPR-Z0-9]"
VIN = r"\b(?:" + "|".join(f"{_L}{{{i}}}[0-9]{_A}{{{16 - i}}}" for i in range(17)) + r")\b"
PHONE = r"(^|[^0-9])((?:\+?1[-.\s]?)?\(?\b[0-9]{3}\b\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4})([^0-9]|$)"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


def mask_steps(x: str) -> list[str]:
    """The text after each masking step; phones twice, as neighbours share their border character."""
    vin = f"regexp_replace({x}, '{VIN}', '[VIN]', 'g')"
    phone = vin
    for _ in range(2):
        phone = f"regexp_replace({phone}, '{PHONE}', '\\1[PHONE]\\3', 'g')"
    email = f"regexp_replace({phone}, '{EMAIL}', '[EMAIL]', 'g')"
    digits = f"regexp_replace({email}, '[0-9]{{8,}}', '[NUM]', 'g')"
    return [vin, phone, email, digits]


def masked(x: str) -> str:
    return mask_steps(x)[-1]


def chunk_ctes(source: str, keys: str, size: int, overlap: int, sep: str) -> str:
    """CTEs giving ``pieces(keys, i, c)`` for ``source(keys, t)``, by recursion over window starts."""

    def end(i: str) -> str:
        win = f"substring(t, {i} + 1, {size})"
        cut = f"(length({win}) - strpos(reverse({win}), reverse({sep})) - length({sep}) + 1)"
        return (
            f"CASE WHEN {i} + {size} < n THEN CASE WHEN contains({win}, {sep}) AND {cut} > 0 "
            f"THEN {i} + {cut} + length({sep}) ELSE {i} + {size} END ELSE n END"
        )

    return f"""sized AS (SELECT {keys}, t, length(t) AS n FROM {source} WHERE length(t) > 0),
w({keys}, t, n, i, e) AS (
  SELECT {keys}, t, n, 0, {end('0')} FROM sized WHERE n > {size}
  UNION ALL
  SELECT {keys}, t, n, i2, {end('i2')} FROM (SELECT {keys}, t, n, greatest(e - {overlap}, i + 1) AS i2 FROM w WHERE e < n)),
pieces AS (
  SELECT {keys}, i, regexp_replace(substring(t, i + 1, e - i), '^\\s+|\\s+$', '', 'g') AS c FROM w
  UNION ALL SELECT {keys}, 0, t FROM sized WHERE n <= {size})"""
