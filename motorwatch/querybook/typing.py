"""Typed tables and the expressions they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import casts, privacy, text
from ..functions.keys import content_hash
from ..plans import typed
from ..sources.taxonomy import resolve_make
from . import feeds, sqltext
from .registry import Tables, query


@query(
    "silver_recalls_like",
    f"""WITH {sqltext.TYPED_RECALLS} SELECT record_id, campaign_number, make_norm, oem_group, model_norm, model_year,
        component_raw, component_group, component_leaf, recall_type_code, units_affected,
        event_date AS owner_notify_date, record_creation_date, fmvss, defect_description FROM recalls""",
)
def silver_recalls_like(t: Tables):
    return typed.recalls(feeds.raw_recalls(t), feeds.as_of()).select(
        "record_id", "campaign_number", "make_norm", "oem_group", "model_norm", "model_year", "component_raw",
        "component_group", "component_leaf", "recall_type_code", "units_affected", "owner_notify_date",
        "record_creation_date", "fmvss", "defect_description",
    )


_COMPLAINT_COLUMNS = (
    "complaint_id", "odi_number", "make_norm", "oem_group", "model_norm", "model_year", "component_group",
    "component_leaf", "incident_date", "crash", "fire", "injured", "deaths", "miles", "city", "state", "narrative_len_orig",
)


@query(
    "silver_complaints_like",
    f"""WITH {sqltext.TYPED_COMPLAINTS} SELECT {', '.join(_COMPLAINT_COLUMNS)}, md5({sqltext.masked('cdescr')}) AS narrative_md5
        FROM complaints""",
)
def silver_complaints_like(t: Tables):
    rows = typed.complaints(feeds.raw_complaints(t), feeds.as_of())
    return rows.select(*_COMPLAINT_COLUMNS, F.md5("narrative_clean").alias("narrative_md5"))


_CASE_COLUMNS = (
    "nhtsa_action_number", "investigation_type", "subject", "mfr_norm", "oem_group", "model_norm", "model_year",
    "component_raw", "component_group", "open_date", "close_date", "days_open", "status",
)


@query("investigation_status", f"WITH {sqltext.TYPED_INVESTIGATIONS} SELECT {', '.join(_CASE_COLUMNS)} FROM investigations")
def investigation_status(t: Tables):
    return typed.investigations(feeds.raw_investigations(t), feeds.as_of()).select(*_CASE_COLUMNS)


_BULLETIN_COLUMNS = (
    "tsb_id", "nhtsa_item_number", "make_norm", "oem_group", "model_norm", "model_year", "component_raw",
    "component_group", "summary", "original_date", "bulletin_year",
)


@query("bulletin_year", f"WITH {sqltext.TYPED_BULLETINS} SELECT {', '.join(_BULLETIN_COLUMNS)} FROM bulletins")
def bulletin_year(t: Tables):
    return typed.bulletins(feeds.raw_bulletins(t), feeds.as_of()).select(*_BULLETIN_COLUMNS)


_LEVEL_SQL = "'L' || regexp_extract(sae_automation_level, '[0-9]', 0)"
_ANY_DATE_SQL = """coalesce(try_strptime(incident_date, '%Y-%m-%d'), try_strptime(incident_date, '%m/%d/%Y'),
    try_strptime(incident_date, '%b-%Y'))::DATE"""


@query(
    "defensive_projection",
    f"""WITH {feeds.SQL_RAW_CRASHES}, {sqltext.NAMES} SELECT report_id, {sqltext.make_norm('make')} AS make_norm,
        {sqltext.oem_group('make')} AS oem_group, {_LEVEL_SQL} AS sae_level, {_ANY_DATE_SQL} AS incident_date_d,
        NULL::VARCHAR AS level_if_absent, NULL::DATE AS date_if_absent
        FROM {sqltext.with_names('raw_crashes', 'make')}""",
)
def defensive_projection(t: Tables):
    """Once with all columns, once from a snapshot that lacks level and date."""
    raw = feeds.raw_crashes(t)
    full = typed.av_crashes(raw).select("report_id", "make_norm", "oem_group", "sae_level", "incident_date_d")
    bare = typed.av_crashes(raw.drop("sae_automation_level", "incident_date", "make")).select(
        "report_id", F.col("sae_level").alias("level_if_absent"), F.col("incident_date_d").alias("date_if_absent")
    )
    return full.join(bare, "report_id")


@query(
    "first_digit_level",
    f"WITH {feeds.SQL_RAW_CRASHES} SELECT report_id, {_LEVEL_SQL} AS sae_level FROM raw_crashes",
)
def first_digit_level(t: Tables):
    return feeds.raw_crashes(t).select("report_id", casts.automation_level("sae_automation_level").alias("sae_level"))


@query(
    "multi_format_date",
    f"WITH {feeds.SQL_RAW_CRASHES} SELECT report_id, incident_date, {_ANY_DATE_SQL} AS parsed FROM raw_crashes",
)
def multi_format_date(t: Tables):
    return feeds.raw_crashes(t).select("report_id", "incident_date", casts.any_date("incident_date").alias("parsed"))


@query(
    "date_clamp",
    f"""SELECT o_orderkey, {sqltext.clamped(feeds.sql_damaged('o_orderkey', 'o_orderdate'))} AS event_date FROM orders""",
)
def date_clamp(t: Tables):
    raw = t.orders.select("o_orderkey", feeds.damaged("o_orderkey", "o_orderdate").alias("raw"))
    return raw.select("o_orderkey", casts.compact_date("raw", feeds.as_of()).alias("event_date"))


_NUMBERS = "CASE l_linenumber % 5 WHEN 0 THEN '' WHEN 1 THEN '12.0' WHEN 2 THEN ' 7 ' WHEN 3 THEN 'n/a' ELSE CAST(l_partkey * 3000000 AS {t}) END"


@query(
    "try_cast_ints",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 5 WHEN 2 THEN 7 WHEN 4 THEN TRY_CAST(l_partkey * 3000000 AS INTEGER) END AS as_int,
        CASE l_linenumber % 5 WHEN 2 THEN 7 WHEN 4 THEN l_partkey * 3000000 END::BIGINT AS as_long FROM lineitem""",
)
def try_cast_ints(t: Tables):
    raw = F.expr(_NUMBERS.format(t="string"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        casts.lenient_int(raw).alias("as_int"), casts.lenient_long(raw).alias("as_long"),
    )


@query(
    "yn_bool",
    f"WITH {feeds.SQL_RAW_COMPLAINTS} SELECT cmplid, coalesce(upper(crash) = 'Y', FALSE) AS crash, coalesce(upper(fire) = 'Y', FALSE) AS fire FROM raw_complaints",
)
def yn_bool(t: Tables):
    return feeds.raw_complaints(t).select(
        "cmplid", casts.yes_flag("crash").alias("crash"), casts.yes_flag("fire").alias("fire")
    )


_PATH_SQL = "CASE p_partkey % 3 WHEN 0 THEN upper(p_type) || ' - ' || upper(p_name) || ': ' || p_brand WHEN 1 THEN p_name || ':' || upper(p_brand) ELSE upper(p_name) END"


def _paths(t: Tables):
    return t.part.select("p_partkey", F.expr(_PATH_SQL).alias("path"))


@query("component_group", f"SELECT p_partkey, {sqltext.component(f'({_PATH_SQL})', 1)} AS component_group FROM part")
def component_group(t: Tables):
    return _paths(t).select("p_partkey", text.component_group("path").alias("component_group"))


@query("component_leaf", f"SELECT p_partkey, {sqltext.component(f'({_PATH_SQL})', -1)} AS component_leaf FROM part")
def component_leaf(t: Tables):
    return _paths(t).select("p_partkey", text.component_leaf("path").alias("component_leaf"))


@query(
    "oem_lookup",
    f"""WITH {sqltext.NAMES}, raw AS (SELECT p_partkey, {feeds.sql_make_of('p_partkey')} AS maketxt FROM part)
        SELECT p_partkey, {sqltext.make_norm('maketxt')} AS make_norm, {sqltext.oem_group('maketxt')} AS oem_group
        FROM {sqltext.with_names('raw')}""",
)
def oem_lookup(t: Tables):
    raw = t.part.select("p_partkey", feeds.make_of("p_partkey").alias("maketxt"))
    return resolve_make(raw, "maketxt").drop("maketxt")


@query("pii_scrub", f"SELECT doc_id, {sqltext.masked('text')} AS clean FROM documents")
def pii_scrub(t: Tables):
    return t.documents.select("doc_id", privacy.mask_personal("text").alias("clean"))


_VIN, _PHONE, _EMAIL, _NUM = sqltext.mask_steps("text")


def _count_sql(text_sql: str, token: str) -> str:
    """Tokens in the text, less those that were in it before."""
    return f"((length({text_sql}) - length(replace({text_sql}, '{token}', ''))) // {len(token)})::INTEGER"


@query(
    "pii_counts",
    f"""SELECT doc_id, {_count_sql('a', '[VIN]')} - {_count_sql('text', '[VIN]')} AS n_vin,
          {_count_sql('b', '[PHONE]')} - {_count_sql('text', '[PHONE]')} AS n_phone,
          {_count_sql('c', '[EMAIL]')} - {_count_sql('text', '[EMAIL]')} AS n_email,
          {_count_sql('d', '[NUM]')} - {_count_sql('text', '[NUM]')} AS n_digits
        FROM (SELECT doc_id, text, {_VIN} AS a, {_PHONE} AS b, {_EMAIL} AS c, {_NUM} AS d FROM documents)""",
)
def pii_counts(t: Tables):
    return t.documents.select("doc_id", *[c.alias(n) for n, c in privacy.mask_tallies("text").items()])


@query(
    "string_funcs",
    """SELECT c_custkey, trim(upper(c_name)) AS name_upper, substring(c_name, 1, 8) AS head, length(c_name)::INTEGER AS n,
         c_mktsegment || ':' || c_name AS joined, split_part(c_name, '#', -1) AS tail,
         coalesce(nullif(c_mktsegment, 'BUILDING'), '?') AS segment, substring(c_name, 1, 5) AS preview FROM customer""",
)
def string_funcs(t: Tables):
    return t.customer.select(
        "c_custkey",
        F.trim(F.upper("c_name")).alias("name_upper"),
        F.substring("c_name", 1, 8).alias("head"),
        F.length("c_name").alias("n"),
        F.concat_ws(":", "c_mktsegment", "c_name").alias("joined"),
        F.element_at(F.split("c_name", "#"), -1).alias("tail"),
        F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("?")).alias("segment"),
        text.preview("c_name", 5).alias("preview"),
    )


@query(
    "title_case_names",
    f"SELECT p_partkey, {sqltext.title(chr(39) + 'ACME (' + chr(39) + ' || upper(p_name) || ' + chr(39) + ')-' + chr(39) + ' || upper(p_type)')} AS titled FROM part",
)
def title_case_names(t: Tables):
    raw = F.concat(F.lit("ACME ("), F.upper("p_name"), F.lit(")-"), F.upper("p_type"))
    return t.part.select("p_partkey", text.title_case(raw).alias("titled"))


@query(
    "date_funcs",
    """SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2001-09-01')::INTEGER AS age_days,
         (o_orderdate::DATE + INTERVAL 3 MONTH)::DATE AS plus_quarter, (o_orderdate::DATE - 90)::DATE AS minus_90,
         date_trunc('month', o_orderdate)::DATE AS month, year(o_orderdate)::INTEGER AS y, quarter(o_orderdate)::INTEGER AS q,
         month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d, strftime(o_orderdate, '%a') AS weekday FROM orders""",
)
def date_funcs(t: Tables):
    day = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey",
        F.datediff(feeds.as_of(), day).alias("age_days"),
        F.add_months(day, 3).alias("plus_quarter"),
        F.date_sub(day, 90).alias("minus_90"),
        F.trunc(day, "month").alias("month"),
        F.year(day).alias("y"),
        F.quarter(day).alias("q"),
        F.month(day).alias("m"),
        F.day(day).alias("d"),
        F.date_format(day, "EEE").alias("weekday"),
    )


@query(
    "null_compare",
    """SELECT c_custkey, least(nullif(c_nationkey, 3), 10) AS low, greatest(nullif(c_nationkey, 3), 10) AS high,
         CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS side FROM customer""",
)
def null_compare(t: Tables):
    some = F.nullif("c_nationkey", F.lit(3))
    return t.customer.select(
        "c_custkey",
        F.least(some, F.lit(10)).alias("low"),
        F.greatest(some, F.lit(10)).alias("high"),
        F.when(F.col("c_acctbal") > 0, "credit").otherwise("debit").alias("side"),
    )


@query("json_props", "SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events")
def json_props(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query(
    "array_hof",
    """SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::INTEGER AS n_positive, len(embedding)::INTEGER AS dim,
         round(embedding[1]::DOUBLE, 6) AS first, round(embedding[-1]::DOUBLE, 6) AS last FROM embeddings""",
)
def array_hof(t: Tables):
    return t.embeddings.select(
        "vec_id",
        F.size(F.filter("embedding", lambda x: x > 0)).alias("n_positive"),
        F.size("embedding").alias("dim"),
        F.round(F.try_element_at("embedding", F.lit(1)).cast("double"), 6).alias("first"),
        F.round(F.element_at("embedding", -1).cast("double"), 6).alias("last"),
    )


@query(
    "hash_ids",
    """SELECT doc_id, sha256(source || '::' || doc_id || '::0') AS chunk_id, substring(sha1(text), 1, 16) AS short_sha1,
         sha256('{"lang":"' || lang || '","n_chars":' || n_chars || '}') AS row_hash FROM documents""",
)
def hash_ids(t: Tables):
    from ..functions.keys import chunk_id

    return t.documents.select(
        "doc_id",
        chunk_id(F.col("source"), F.col("doc_id").cast("string"), F.lit(0)).alias("chunk_id"),
        F.substring(F.sha1("text"), 1, 16).alias("short_sha1"),
        content_hash("lang", "n_chars").alias("row_hash"),
    )


@query(
    "predicates",
    f"""SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '{feeds.AS_OF}' - 900
          AND o_orderdate::DATE >= (DATE '{feeds.AS_OF}' - INTERVAL 36 MONTH)::DATE AND o_orderdate >= DATE '1999-01-01'
          AND (o_orderstatus IS NULL OR upper(o_orderstatus) = 'O') AND o_orderpriority LIKE '%-%'
          AND regexp_matches(o_orderpriority, '^[1-3]') AND strftime(o_orderdate, '%Y%m%d') >= '19990301'""",
)
def predicates(t: Tables):
    from ..plans.reports import since_days, since_months

    rows = t.orders.where(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    rows = rows.withColumn("day", F.col("o_orderdate").cast("date"))
    return rows.where(
        since_days(feeds.as_of(), 900, "day")
        & since_months(feeds.as_of(), 36, "day")
        & (F.col("o_orderstatus").isNull() | (F.upper("o_orderstatus") == "O"))
        & F.col("o_orderpriority").like("%-%")
        & F.col("o_orderpriority").rlike("^[1-3]")
        & (feeds.compact("day") >= "19990301")
    ).select("o_orderkey")
