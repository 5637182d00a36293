"""The given tables seen as the domain's raw feeds, once for Spark and once as SQL for the checks.

Orders stand for recall campaigns and investigations, their lines for the vehicles covered,
parts for makes and components, documents for complaint narratives, events for crash reports.
Nothing is left out: every row of the given tables becomes a row of a feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import lenient_int
from ..functions.text import component_group, component_leaf
from ..session import drop_path, freed_shuffles, stage
from ..sources.taxonomy import resolve_make
from .registry import Tables

AS_OF = "2001-09-01"

# Raw makes, assigned by part key: variants, all caps, unknown names, blanks.
MAKES = (
    "CHEVY", "TOYOTA", "Honda", "ZYX-MOTORS", "  FORD ", "vw", "MERCEDES BENZ", "ALFA-ROMEO",
    "BMW", "ROLLS ROYCE", "", "tesla", "RIVIAN", "GMC", "land rover", "ACME (NA)/X",
)


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def make_of(key: str) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MAKES]), (F.pmod(F.col(key), F.lit(len(MAKES))) + 1).cast("int"))


def sql_make_of(key: str) -> str:
    return "[" + ", ".join(f"'{m}'" for m in MAKES) + f"][1 + {key} % {len(MAKES)}]"


def compact(day: str) -> Column:
    return F.date_format(F.col(day).cast("date"), "yyyyMMdd")


# The damage found in date fields, by key modulo 50.
_DAMAGE = {0: "''", 1: "'00000000'", 2: "'00031020'", 3: "'22030726'", 4: "'20230229'", 5: "NULL"}


def damaged(key: str, day: str) -> Column:
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in _DAMAGE.items())
    return F.expr(f"CASE {key} % 50 {cases} ELSE date_format(CAST({day} AS date), 'yyyyMMdd') END")


def sql_damaged(key: str, day: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in _DAMAGE.items())
    return f"CASE {key} % 50 {cases} ELSE strftime({day}, '%Y%m%d') END"


def covered(t: Tables) -> DataFrame:
    """Order lines with their order and part."""
    return t.made("covered", lambda: t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        t.part, F.col("l_partkey") == F.col("p_partkey")
    ))


def supplied(t: Tables) -> DataFrame:
    """Order lines with their part."""
    return t.made("supplied", lambda: t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")))


_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")
_PART = ("p_partkey", "p_name", "p_brand", "p_type", "p_size")
_ORDER = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def write_lines(t: Tables, *names: str) -> None:
    """Works the joins below the line feeds out once, for queries that read these feeds several times."""
    joins = {"covered": (covered, (*_LINE, *_ORDER, *_PART)), "supplied": (supplied, (*_LINE, *_PART))}
    for name in names:
        join, columns = joins[name]
        with freed_shuffles(t.spark):
            t.keep(name, stage(join(t).select(*columns), name, "zstd"))


def drop_lines(t: Tables, *names: str) -> None:
    """Removes what :func:`write_lines` wrote, once all feeds are taken in; the names then stand for the joins again."""
    for name in names:
        for folder in {file.rpartition("/")[0] for file in t.made(name, lambda: None).inputFiles()}:
            drop_path(t.spark, folder)
        t.forget(name)


_YEAR = "CASE p_size % 10 WHEN 0 THEN '' WHEN 1 THEN '2004.0' WHEN 2 THEN ' 2005 ' ELSE CAST(1970 + p_size AS {text}) END"
_COMPONENT = (
    "CASE p_size % 7 WHEN 0 THEN NULL WHEN 1 THEN p_brand "
    "ELSE upper(p_type) || ':' || upper(p_name) || ':' || p_brand END"
)


def raw_recalls(t: Tables) -> DataFrame:
    return covered(t).select(
        F.expr("CAST(l_orderkey AS string) || '-' || l_partkey || '-' || l_linenumber || '-' || l_suppkey").alias("record_id"),
        F.col("o_orderkey").cast("string").alias("campno"),
        make_of("p_partkey").alias("maketxt"),
        F.col("p_name").alias("modeltxt"),
        F.expr(_YEAR.format(text="string")).alias("yeartxt"),
        F.col("o_orderpriority").alias("mfgcampno"),
        F.expr(_COMPONENT).alias("compname"),
        F.col("l_returnflag").alias("rcltypecd"),
        F.floor("o_totalprice").cast("string").alias("potaff"),
        damaged("o_orderkey", "o_orderdate").alias("odate"),
        compact("l_shipdate").alias("rcdate"),
        F.lit(None).cast("string").alias("bgman"),
        F.lit("00000000").alias("endman"),
        F.col("l_linestatus").alias("fmvss"),
        F.col("p_name").alias("desc_defect"),
    )


SQL_RAW_RECALLS = f"""raw_recalls AS (
  SELECT l_orderkey::VARCHAR || '-' || l_partkey || '-' || l_linenumber || '-' || l_suppkey AS record_id,
    o_orderkey::VARCHAR AS campno, {sql_make_of('p_partkey')} AS maketxt, p_name AS modeltxt,
    {_YEAR.format(text='VARCHAR')} AS yeartxt, o_orderpriority AS mfgcampno, {_COMPONENT} AS compname,
    l_returnflag AS rcltypecd, floor(o_totalprice)::BIGINT::VARCHAR AS potaff,
    {sql_damaged('o_orderkey', 'o_orderdate')} AS odate, strftime(l_shipdate, '%Y%m%d') AS rcdate,
    l_linestatus AS fmvss, p_name AS desc_defect
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

def products(t: Tables) -> DataFrame:
    """Every part as a vehicle and component, typed: where the dimensions of the line feeds come from."""
    raw = t.part.select(
        make_of("p_partkey").alias("maketxt"),
        F.col("p_name").alias("model_norm"),
        lenient_int(F.expr(_YEAR.format(text="string"))).alias("model_year"),
        F.expr(_COMPONENT).alias("component_raw"),
    )
    typed = raw.withColumns(
        {"component_group": component_group("component_raw"), "component_leaf": component_leaf("component_raw")}
    )
    return resolve_make(typed, "maketxt")


_ACTION = "CASE o_custkey % 5 WHEN 0 THEN 'PE' WHEN 1 THEN 'EA' WHEN 2 THEN 'DP' WHEN 3 THEN 'RQ' ELSE 'AQ' END"


def raw_investigations(t: Tables) -> DataFrame:
    """One row per (order, line): an investigation and a vehicle it covers."""
    closed = "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE date_format(date_add(CAST(o_orderdate AS date), CAST(o_custkey % 400 AS int)), 'yyyyMMdd') END"
    return covered(t).select(
        F.expr(f"{_ACTION} || CAST(o_orderkey AS string)").alias("nhtsa_action_number"),
        make_of("p_partkey").alias("maketxt"),
        F.col("p_name").alias("modeltxt"),
        F.expr(_YEAR.format(text="string")).alias("yeartxt"),
        F.expr(_COMPONENT).alias("component_name"),
        F.upper("p_brand").alias("mfr_name"),
        damaged("o_orderkey", "o_orderdate").alias("action_open_date"),
        F.expr(closed).alias("action_close_date"),
        F.col("o_orderkey").cast("string").alias("campno"),
        F.col("o_orderpriority").alias("subject"),
        F.col("p_type").alias("summary"),
    )


SQL_RAW_INVESTIGATIONS = f"""raw_investigations AS (
  SELECT {_ACTION} || o_orderkey::VARCHAR AS nhtsa_action_number, {sql_make_of('p_partkey')} AS maketxt,
    p_name AS modeltxt, {_YEAR.format(text='VARCHAR')} AS yeartxt, {_COMPONENT} AS component_name,
    {sql_damaged('o_orderkey', 'o_orderdate')} AS action_open_date,
    CASE WHEN o_orderstatus = 'O' THEN NULL
      ELSE strftime(o_orderdate::DATE + (o_custkey % 400)::INTEGER, '%Y%m%d') END AS action_close_date,
    o_orderpriority AS subject
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def raw_complaints(t: Tables) -> DataFrame:
    n = F.lit(None).cast("string")
    return t.documents.select(
        F.col("doc_id").cast("string").alias("cmplid"),
        F.concat(F.lit("ODI"), F.col("doc_id").cast("string")).alias("odino"),
        make_of("doc_id").alias("maketxt"),
        F.col("lang").alias("modeltxt"),
        F.expr("CAST(1990 + n_chars % 35 AS string)").alias("yeartxt"),
        F.expr("CASE doc_id % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'y' WHEN 2 THEN 'N' WHEN 3 THEN '' END").alias("crash"),
        F.expr("CASE doc_id % 3 WHEN 0 THEN 'Y' END").alias("fire"),
        F.expr("date_format(date_add(DATE '1994-01-01', CAST(doc_id * 37 % 9000 AS int)), 'yyyyMMdd')").alias("faildate"),
        F.expr("CAST(n_chars % 4 AS string)").alias("injured"),
        F.expr("CASE n_chars % 11 WHEN 0 THEN '1' ELSE '' END").alias("deaths"),
        F.expr("CAST(n_chars * 10 AS string)").alias("miles"),
        F.expr("upper(source) || ':' || upper(lang) || ' PART'").alias("compdesc"),
        F.col("lang").alias("city"),
        F.upper("source").alias("state"),
        F.col("text").alias("cdescr"),
        F.lit("VOQ").alias("cmpl_type"),
        n.alias("ldate"),
        n.alias("datea"),
    )


SQL_RAW_COMPLAINTS = f"""raw_complaints AS (
  SELECT doc_id::VARCHAR AS cmplid, 'ODI' || doc_id AS odino, {sql_make_of('doc_id')} AS maketxt, lang AS modeltxt,
    (1990 + n_chars % 35)::VARCHAR AS yeartxt,
    CASE doc_id % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'y' WHEN 2 THEN 'N' WHEN 3 THEN '' END AS crash,
    CASE doc_id % 3 WHEN 0 THEN 'Y' END AS fire,
    strftime(DATE '1994-01-01' + (doc_id * 37 % 9000)::INTEGER, '%Y%m%d') AS faildate,
    (n_chars % 4)::VARCHAR AS injured, CASE n_chars % 11 WHEN 0 THEN '1' ELSE '' END AS deaths,
    (n_chars * 10)::VARCHAR AS miles, upper(source) || ':' || upper(lang) || ' PART' AS compdesc,
    lang AS city, upper(source) AS state, text AS cdescr
  FROM documents)"""


def raw_bulletins(t: Tables) -> DataFrame:
    """One row per order line: a bulletin, the product and the component it concerns."""
    return supplied(t).select(
        F.col("l_suppkey").cast("string").alias("nhtsa_item_number"),
        F.col("l_returnflag").alias("replacement_bulletin_no"),
        compact("l_shipdate").alias("changed_date"),
        F.concat(F.lit("SB-"), F.col("l_partkey").cast("string")).alias("tsb_id"),
        damaged("l_orderkey", "l_shipdate").alias("orig_date"),
        F.col("l_linestatus").alias("communication_type"),
        make_of("p_partkey").alias("maketxt"),
        F.col("p_name").alias("modeltxt"),
        F.expr(_YEAR.format(text="string")).alias("yeartxt"),
        F.expr(_COMPONENT).alias("component_desc"),
        F.col("p_type").alias("mfr_component_system"),
        F.col("p_brand").alias("mfr_component_subsystem"),
        F.expr("'Bulletin on ' || p_name || ' of ' || p_brand").alias("summary"),
    )


SQL_RAW_BULLETINS = f"""raw_bulletins AS (
  SELECT l_suppkey::VARCHAR AS nhtsa_item_number, 'SB-' || l_partkey AS tsb_id,
    {sql_damaged('l_orderkey', 'l_shipdate')} AS orig_date, {sql_make_of('p_partkey')} AS maketxt, p_name AS modeltxt,
    {_YEAR.format(text='VARCHAR')} AS yeartxt, {_COMPONENT} AS component_desc,
    'Bulletin on ' || p_name || ' of ' || p_brand AS summary
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


_CRASH_DATE = {
    "spark": "CASE event_id % 4 WHEN 0 THEN date_format(CAST(ts AS date), 'yyyy-MM-dd') WHEN 1 THEN date_format(CAST(ts AS date), 'MM/dd/yyyy') "
    "WHEN 2 THEN upper(date_format(CAST(ts AS date), 'MMM-yyyy')) ELSE 'unknown' END",
    "duck": "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%m/%d/%Y') "
    "WHEN 2 THEN upper(strftime(ts, '%b-%Y')) ELSE 'unknown' END",
}
_LEVEL = "CASE event_type WHEN 'view' THEN 'Level 4' WHEN 'click' THEN 'L3' WHEN 'signup' THEN 'SAE 2 (partial)' WHEN 'error' THEN 'none' END"


def raw_crashes(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").cast("string").alias("report_id"),
        make_of("user_id").alias("make"),
        F.expr(_LEVEL).alias("sae_automation_level"),
        F.expr(_CRASH_DATE["spark"]).alias("incident_date"),
        F.concat(F.lit("Report of "), "event_type", F.lit(" by "), F.col("user_id").cast("string")).alias("narrative"),
        F.col("event_type").alias("city"),
    )


SQL_RAW_CRASHES = f"""raw_crashes AS (
  SELECT event_id::VARCHAR AS report_id, {sql_make_of('user_id')} AS make, {_LEVEL} AS sae_automation_level,
    {_CRASH_DATE['duck']} AS incident_date, 'Report of ' || event_type || ' by ' || user_id AS narrative, event_type AS city
  FROM events)"""
