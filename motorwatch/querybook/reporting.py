"""Star schema and the reports on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.worklist import point_lookup as lookup
from ..plans import reports, star, typed
from . import feeds, sqltext
from .registry import Tables, query

_R = f"WITH {sqltext.TYPED_RECALLS}"
_C = f"WITH {sqltext.TYPED_COMPLAINTS}"
_I = f"WITH {sqltext.TYPED_INVESTIGATIONS}"
_B = f"WITH {sqltext.TYPED_BULLETINS}"
_TODAY = f"DATE '{feeds.AS_OF}'"


class Star:
    """Typed tables, facts and dimensions as plans over the given tables, made when asked for."""

    def __init__(self, t: Tables):
        self._t = t

    def __getattr__(self, name: str) -> DataFrame:
        base, _, kind = name.partition("_")
        if kind == "fact":
            made = getattr(star, name)(getattr(self, base))
        else:
            made = getattr(typed, base)(getattr(feeds, f"raw_{base}")(self._t), feeds.as_of())
        self.__dict__[name] = made
        return made

    @property
    def products(self) -> DataFrame:
        return feeds.products(self._t)

    @property
    def product_parts(self) -> DataFrame:
        """Products whose component counts as a whole, as in feeds without a leaf column."""
        return feeds.products(self._t).drop("component_leaf")

    def vehicles(self, *names: str) -> DataFrame:
        return star.dim_vehicle(*[getattr(self, n) for n in names])

    def components(self, *names: str) -> DataFrame:
        return star.dim_component(*[getattr(self, n) for n in names])

    def groups(self, *names: str) -> DataFrame:
        return star.dim_oem_group(*[getattr(self, n) for n in names])


# ---------------------------------------------------------------- dimensions

_THREE = ("recalls", "complaints", "bulletins")


@query(
    "dim_vehicle",
    f"""{_R}, {sqltext.TYPED_COMPLAINTS.replace(sqltext.NAMES + ', ', '')}, {sqltext.TYPED_BULLETINS.replace(sqltext.NAMES + ', ', '')}
        SELECT DISTINCT coalesce(make_norm, '') AS make_norm, coalesce(model_norm, '') AS model_norm, model_year FROM (
          SELECT make_norm, model_norm, model_year FROM recalls UNION ALL SELECT make_norm, model_norm, model_year FROM complaints
          UNION ALL SELECT make_norm, model_norm, model_year FROM bulletins)""",
)
def dim_vehicle(t: Tables):
    return Star(t).vehicles(*_THREE).drop("vehicle_key")


@query(
    "dim_component",
    f"""{_R}, {sqltext.TYPED_COMPLAINTS.replace(sqltext.NAMES + ', ', '')}, {sqltext.TYPED_BULLETINS.replace(sqltext.NAMES + ', ', '')},
          {sqltext.TYPED_INVESTIGATIONS.replace(sqltext.NAMES + ', ', '')}
        SELECT DISTINCT coalesce(component_group, '') AS component_group, coalesce(component_leaf, '') AS component_leaf FROM (
          SELECT component_group, component_leaf FROM recalls UNION ALL SELECT component_group, component_leaf FROM complaints
          UNION ALL SELECT component_group, component_raw FROM bulletins UNION ALL SELECT component_group, component_raw FROM investigations)""",
)
def dim_component(t: Tables):
    return Star(t).components(*_THREE, "investigations").drop("component_id")


@query(
    "union_dims",
    f"""{_R}, {sqltext.TYPED_COMPLAINTS.replace(sqltext.NAMES + ', ', '')}, {sqltext.TYPED_BULLETINS.replace(sqltext.NAMES + ', ', '')}
        SELECT DISTINCT oem_group FROM (SELECT oem_group FROM recalls UNION ALL SELECT oem_group FROM complaints UNION ALL SELECT oem_group FROM bulletins)""",
)
def union_dims(t: Tables):
    return Star(t).groups(*_THREE).drop("oem_group_id")


@query("dim_distinct", "SELECT DISTINCT p_brand, p_type, p_size FROM part")
def dim_distinct(t: Tables):
    return t.part.select("p_brand", "p_type", "p_size").dropDuplicates()


@query(
    "dim_date",
    f"""{_R}, {sqltext.TYPED_COMPLAINTS.replace(sqltext.NAMES + ', ', '')}, {sqltext.TYPED_INVESTIGATIONS.replace(sqltext.NAMES + ', ', '')},
        bounds AS (SELECT greatest(min(lo), DATE '1950-01-01') AS lo, greatest(max(hi), {_TODAY}) AS hi FROM (
          SELECT min(record_creation_date) AS lo, max(record_creation_date) AS hi FROM recalls UNION ALL
          SELECT min(incident_date), max(incident_date) FROM complaints UNION ALL SELECT min(open_date), max(open_date) FROM investigations)),
        days AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS date_key FROM bounds)
        SELECT date_key, year(date_key)::INTEGER AS year, quarter(date_key)::INTEGER AS quarter, month(date_key)::INTEGER AS month,
          day(date_key)::INTEGER AS day, strftime(date_key, '%a') AS day_of_week, date_key = {_TODAY} AS is_today FROM days""",
)
def dim_date(t: Tables):
    s = Star(t)
    dates = [(s.recalls, "record_creation_date"), (s.complaints, "incident_date"), (s.investigations, "open_date")]
    return star.calendar(t.spark, dates, feeds.as_of())


# --------------------------------------------------------------------- facts


@query(
    "fact_keys",
    f"""{_R} SELECT count(*) AS n_rows, count(DISTINCT (coalesce(make_norm, ''), coalesce(model_norm, ''), coalesce(model_year::VARCHAR, ''))) AS n_vehicles,
          count(DISTINCT (coalesce(component_group, ''), coalesce(component_leaf, ''))) AS n_components,
          count(DISTINCT coalesce(oem_group, 'UNKNOWN')) AS n_groups FROM recalls""",
)
def fact_keys(t: Tables):
    """As many keys as there are attribute combinations: no collisions, no splits."""
    fact = Star(t).recalls_fact
    return fact.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("vehicle_key").alias("n_vehicles"),
        F.countDistinct("component_id").alias("n_components"),
        F.countDistinct("oem_group_id").alias("n_groups"),
    )


@query(
    "xxhash_keys",
    f"""{_R}, v AS (SELECT DISTINCT coalesce(make_norm, '') AS a, coalesce(model_norm, '') AS b, coalesce(model_year::VARCHAR, '') AS c FROM recalls),
          k AS (SELECT DISTINCT coalesce(component_group, '') AS a, coalesce(component_leaf, '') AS b FROM recalls),
          g AS (SELECT DISTINCT coalesce(oem_group, 'UNKNOWN') AS a FROM recalls)
        SELECT 'vehicle' AS dimension, count(*) AS n_rows, count(*) AS n_keys, 0::BIGINT AS n_null FROM v
        UNION ALL SELECT 'component', count(*), count(*), 0 FROM k UNION ALL SELECT 'group', count(*), count(*), 0 FROM g""",
)
def xxhash_keys(t: Tables):
    """Every dimension has one key per row, and no row is without a key."""
    s = Star(t)
    dims = (("vehicle", s.vehicles("recalls"), "vehicle_key"), ("component", s.components("recalls"), "component_id"), ("group", s.groups("recalls"), "oem_group_id"))
    counted = [
        dim.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.count_if(F.col(key).isNull()).alias("n_null"))
        .select(F.lit(name).alias("dimension"), "n_rows", "n_keys", "n_null")
        for name, dim, key in dims
    ]
    return counted[0].union(counted[1]).union(counted[2])


def _named(fact: DataFrame, vehicles=None, components=None, groups=None) -> DataFrame:
    """A fact with its keys replaced by what they stand for; inner joins, so an unmet key would show."""
    for dim, key in ((vehicles, "vehicle_key"), (components, "component_id"), (groups, "oem_group_id")):
        if dim is not None:
            fact = fact.join(dim, key)
    return fact.drop("vehicle_key", "component_id", "oem_group_id")


_ATTR = """coalesce(make_norm, '') AS make_norm, coalesce(model_norm, '') AS model_norm, model_year,
  coalesce(component_group, '') AS component_group, coalesce({leaf}, '') AS component_leaf, oem_group"""


@query(
    "fact_recalls",
    f"""{_R} SELECT record_id, campaign_number, units_affected, event_date, recall_type_code, fmvss, {_ATTR.format(leaf='component_leaf')} FROM recalls""",
)
def fact_recalls(t: Tables):
    s = Star(t)
    return _named(s.recalls_fact, s.vehicles("products"), s.components("products"), s.groups("products"))


@query(
    "fact_complaints",
    f"""{_C} SELECT complaint_id, odi_number, incident_date AS event_date, crash, fire, injured, deaths, miles, state, 'VOQ' AS complaint_source,
        {_ATTR.format(leaf='component_leaf')} FROM complaints""",
)
def fact_complaints(t: Tables):
    s = Star(t)
    return _named(s.complaints_fact, s.vehicles("complaints"), s.components("complaints"), s.groups("complaints"))


@query(
    "fact_bulletins",
    f"""{_B} SELECT tsb_id, nhtsa_item_number, original_date AS event_date, bulletin_year, {_ATTR.format(leaf='component_raw')} FROM bulletins""",
)
def fact_bulletins(t: Tables):
    s = Star(t)
    fact = s.bulletins_fact.drop(
        "replacement_bulletin_no", "communication_type", "mfr_component_system", "mfr_component_subsystem"
    )
    return _named(fact, s.vehicles("products"), s.components("product_parts"), s.groups("products"))


@query(
    "fact_investigations",
    f"""{_I} SELECT nhtsa_action_number, investigation_type, status, days_open, open_date AS event_date, close_date,
          coalesce(mfr_norm, '') AS make_norm, coalesce(model_norm, '') AS model_norm, model_year, coalesce(component_group, '') AS component_group, coalesce(component_raw, '') AS component_leaf, oem_group FROM investigations""",
)
def fact_investigations(t: Tables):
    s = Star(t)
    return _named(s.investigations_fact, s.vehicles("products"), s.components("product_parts"), s.groups("products"))


@query(
    "fact_av_crashes",
    f"""WITH {feeds.SQL_RAW_CRASHES}, {sqltext.NAMES} SELECT report_id, 'L' || regexp_extract(sae_automation_level, '[0-9]', 0) AS sae_level,
          coalesce(try_strptime(incident_date, '%Y-%m-%d'), try_strptime(incident_date, '%m/%d/%Y'), try_strptime(incident_date, '%b-%Y'))::DATE AS event_date,
          narrative, city, coalesce({sqltext.make_norm('make')}, '') AS make_norm, '' AS model_norm, NULL::INTEGER AS model_year,
          {sqltext.oem_group('make')} AS oem_group FROM {sqltext.with_names('raw_crashes', 'make')}""",
)
def fact_av_crashes(t: Tables):
    crashes = typed.av_crashes(feeds.raw_crashes(t))
    return _named(star.av_crashes_fact(crashes), star.dim_vehicle(crashes), None, star.dim_oem_group(crashes))


# ------------------------------------------------------------------- figures


@query(
    "kpi_distinct",
    f"{_R} SELECT count(DISTINCT campaign_number) AS n_campaigns FROM recalls WHERE event_date >= {_TODAY} - 365",
)
def kpi_distinct(t: Tables):
    fact = Star(t).recalls_fact.where(reports.since_days(feeds.as_of(), 365))
    return reports.distinct_total(fact, "campaign_number", "n_campaigns")


@query(
    "dedup_sum",
    f"""{_R} SELECT coalesce(sum(units_affected), 0)::BIGINT AS units FROM (
          SELECT DISTINCT campaign_number, units_affected FROM recalls WHERE event_date >= {_TODAY} - 365)""",
)
def dedup_sum(t: Tables):
    fact = Star(t).recalls_fact.where(reports.since_days(feeds.as_of(), 365))
    return reports.deduplicated_sum(fact, "campaign_number", "units_affected", "units")


@query("kpi_count", f"{_C} SELECT count(*) AS n_complaints FROM complaints WHERE incident_date >= {_TODAY} - 90")
def kpi_count(t: Tables):
    fact = Star(t).complaints_fact.where(reports.since_days(feeds.as_of(), 90))
    return fact.agg(F.count("*").alias("n_complaints"))


@query(
    "kpi_open_cases",
    f"{_I} SELECT count(DISTINCT nhtsa_action_number) AS n_open FROM investigations WHERE close_date IS NULL OR upper(status) = 'OPEN'",
)
def kpi_open_cases(t: Tables):
    return reports.distinct_total(Star(t).investigations_fact.where(reports.is_open()), "nhtsa_action_number", "n_open")


@query(
    "top_groups",
    f"""{_R} SELECT oem_group, count(DISTINCT campaign_number) AS recalls FROM recalls
        WHERE year(event_date) = 1999 AND oem_group IS NOT NULL GROUP BY oem_group ORDER BY recalls DESC, oem_group LIMIT 10""",
)
def top_groups(t: Tables):
    s = Star(t)
    fact = s.recalls_fact.where(reports.in_year(F.lit(1999)))
    return reports.top_by_distinct(fact, s.groups("products"), "oem_group_id", "oem_group", "campaign_number", "recalls")


@query(
    "top_components_recent",
    f"""{_C} SELECT component_group, count(*) AS complaints FROM complaints
        WHERE incident_date >= {_TODAY} - 900 AND component_group IS NOT NULL GROUP BY component_group ORDER BY complaints DESC, component_group LIMIT 10""",
)
def top_components_recent(t: Tables):
    s = Star(t)
    fact = s.complaints_fact.where(reports.since_days(feeds.as_of(), 900))
    return reports.top_by_count(fact, s.components("complaints"), "component_id", "component_group", "complaints")


@query(
    "fire_by_group",
    f"""{_C} SELECT oem_group, count(*) AS n_fire_complaints FROM complaints
        WHERE fire AND oem_group IS NOT NULL AND incident_date >= ({_TODAY} - INTERVAL 36 MONTH)::DATE GROUP BY oem_group
        ORDER BY n_fire_complaints DESC, oem_group LIMIT 10""",
)
def fire_by_group(t: Tables):
    s = Star(t)
    fact = s.complaints_fact.where(F.col("fire") & reports.since_months(feeds.as_of(), 36))
    return reports.top_by_count(fact, s.groups("complaints"), "oem_group_id", "oem_group", "n_fire_complaints")


@query(
    "open_by_component",
    f"""{_I} SELECT coalesce(component_group, '') AS component_group, count(*) AS n_open FROM investigations WHERE status = 'open' GROUP BY 1""",
)
def open_by_component(t: Tables):
    s = Star(t)
    fact = s.investigations_fact.where("status = 'open'")
    return reports.top_by_count(
        fact, s.components("product_parts"), "component_id", "component_group", "n_open", k=None
    )


@query(
    "monthly_trend",
    f"""{_R} SELECT date_trunc('month', event_date)::DATE AS month, count(DISTINCT campaign_number) AS recalls FROM recalls
        WHERE event_date >= ({_TODAY} - INTERVAL 24 MONTH)::DATE GROUP BY 1""",
)
def monthly_trend(t: Tables):
    fact = Star(t).recalls_fact.where(reports.since_months(feeds.as_of(), 24))
    return reports.monthly_distinct(fact, "campaign_number", "recalls")


@query(
    "active_cases",
    f"""{_I} SELECT DISTINCT nhtsa_action_number AS action_number, investigation_type AS type, status, days_open, oem_group AS oem,
          coalesce(component_group, '') AS component, open_date AS opened FROM investigations
        WHERE close_date IS NULL OR upper(status) = 'OPEN' ORDER BY opened DESC NULLS LAST, action_number, component, oem NULLS FIRST LIMIT 50""",
)
def active_cases(t: Tables):
    s = Star(t)
    return reports.active_cases(s.investigations_fact, s.groups("products"), s.components("product_parts"))


@query(
    "campaigns_by_make_year",
    f"""{_R} SELECT coalesce(make_norm, '') AS make_norm, year(event_date)::INTEGER AS yr, count(DISTINCT campaign_number) AS n_campaigns
        FROM recalls GROUP BY 1, 2""",
)
def campaigns_by_make_year(t: Tables):
    s = Star(t)
    return reports.campaigns_by_make_and_year(s.recalls_fact, s.vehicles("products"))


@query(
    "campaigns_of_make",
    f"{_R} SELECT count(DISTINCT campaign_number) AS n_campaigns FROM recalls WHERE make_norm = 'Toyota' AND year(event_date) = 1998",
)
def campaigns_of_make(t: Tables):
    s = Star(t)
    return reports.campaigns_for(s.recalls_fact, s.vehicles("products"), "Toyota", 1998)


@query(
    "units_by_component",
    f"""{_R} SELECT coalesce(component_group, '') AS component_group, sum(units_affected)::BIGINT AS units FROM recalls GROUP BY 1
        ORDER BY units DESC, component_group LIMIT 10""",
)
def units_by_component(t: Tables):
    s = Star(t)
    return reports.top_by_sum(s.recalls_fact, s.components("products"), "component_id", "component_group", "units_affected", "units")


@query(
    "injuries_by_make_year",
    f"""{_C} SELECT coalesce(make_norm, '') AS make_norm, year(incident_date)::INTEGER AS yr, sum(injured)::BIGINT AS injuries FROM complaints
        WHERE incident_date >= ({_TODAY} - INTERVAL 60 MONTH)::DATE GROUP BY 1, 2""",
)
def injuries_by_make_year(t: Tables):
    s = Star(t)
    fact = s.complaints_fact.where(reports.since_months(feeds.as_of(), 60))
    return reports.sum_by_make_and_year(fact, s.vehicles("complaints"), "injured", "injuries")


# ------------------------------------------------------------------ profiles


@query(
    "table_profile",
    f"""{_R} SELECT count(*) AS n_rows, count(DISTINCT campaign_number) AS campaigns, count(DISTINCT make_norm) AS makes,
          sum(units_affected)::BIGINT AS total_units, min(record_creation_date) AS earliest, max(record_creation_date) AS latest FROM recalls""",
)
def table_profile(t: Tables):
    return reports.profile(
        Star(t).recalls,
        {
            "n_rows": F.count("*"),
            "campaigns": F.countDistinct("campaign_number"),
            "makes": F.countDistinct("make_norm"),
            "total_units": F.sum("units_affected"),
            "earliest": F.min("record_creation_date"),
            "latest": F.max("record_creation_date"),
        },
    )


@query(
    "complaint_profile",
    f"""{_C} SELECT count(*) AS n_rows, count(DISTINCT make_norm) AS makes, sum(crash::INTEGER)::BIGINT AS crashes, sum(fire::INTEGER)::BIGINT AS fires,
          sum(injured)::BIGINT AS total_injured, sum(deaths)::BIGINT AS total_deaths, round(avg(narrative_len_orig), 6) AS avg_narrative FROM complaints""",
)
def complaint_profile(t: Tables):
    return reports.profile(
        Star(t).complaints,
        {
            "n_rows": F.count("*"),
            "makes": F.countDistinct("make_norm"),
            "crashes": F.count_if("crash"),
            "fires": F.count_if("fire"),
            "total_injured": F.sum("injured"),
            "total_deaths": F.sum("deaths"),
            "avg_narrative": F.round(F.avg("narrative_len_orig"), 6),
        },
    )


@query(
    "group_profile",
    f"""{_I} SELECT investigation_type, status, count(*) AS cases, round(avg(days_open), 6) AS avg_days_open, max(days_open) AS max_days_open
        FROM investigations GROUP BY 1, 2""",
)
def group_profile(t: Tables):
    metrics = {"cases": F.count("*"), "avg_days_open": F.round(F.avg("days_open"), 6), "max_days_open": F.max("days_open")}
    return reports.profile(Star(t).investigations, metrics, ("investigation_type", "status"))


@query(
    "profile_levels",
    f"""{_I} SELECT CASE GROUPING_ID(investigation_type, status) WHEN 3 THEN '' WHEN 1 THEN 'investigation_type' WHEN 2 THEN 'status' ELSE 'investigation_type,status' END AS level,
          investigation_type, status, count(*) AS cases, count(DISTINCT oem_group) AS makers, round(avg(days_open), 6) AS avg_days_open, max(days_open) AS max_days_open
        FROM investigations GROUP BY GROUPING SETS ((), (investigation_type), (status), (investigation_type, status))""",
)
def profile_levels(t: Tables):
    """Total, each group and each pair, in one pass."""
    metrics = {
        "cases": F.count("*"), "makers": F.countDistinct("oem_group"), "avg_days_open": F.round(F.avg("days_open"), 6), "max_days_open": F.max("days_open")
    }
    return reports.profile_levels(Star(t).investigations, metrics, [(), ("investigation_type",), ("status",), ("investigation_type", "status")])


@query(
    "documents_by_type",
    f"""WITH {feeds.SQL_RAW_INVESTIGATIONS} SELECT substring(nhtsa_action_number, 1, 2) AS investigation_type,
          count(DISTINCT nhtsa_action_number) AS investigations, count(*) AS documents FROM raw_investigations GROUP BY 1""",
)
def documents_by_type(t: Tables):
    metrics = {"investigations": F.countDistinct("nhtsa_action_number"), "documents": F.count("*")}
    kind = F.substring("nhtsa_action_number", 1, 2).alias("investigation_type")
    return reports.profile(feeds.raw_investigations(t), metrics, (kind,))


@query("crash_levels", f"WITH {feeds.SQL_RAW_CRASHES} SELECT 'L' || regexp_extract(sae_automation_level, '[0-9]', 0) AS sae_level, count(*) AS n FROM raw_crashes GROUP BY 1")
def crash_levels(t: Tables):
    return reports.ranked_groups(typed.av_crashes(feeds.raw_crashes(t)), "sae_level")


# ---------------------------------------------------------- analyst questions


@query(
    "keyword_count",
    f"""{_C} SELECT count(*) AS n FROM complaints WHERE year(incident_date) BETWEEN 1998 AND 2000
          AND lower(cdescr) LIKE '%the%' AND (lower(cdescr) LIKE '%tion%' OR lower(cdescr) LIKE '%fire%')""",
)
def keyword_count(t: Tables):
    rows = feeds.raw_complaints(t).withColumn("event_date", F.to_date("faildate", "yyyyMMdd"))
    rows = rows.where(F.col("event_date").between(F.lit("1998-01-01").cast("date"), F.lit("2000-12-31").cast("date")))
    return rows.where(reports.keyword_test("cdescr", all_of=("THE",), any_of=("tion", "fire"))).agg(F.count("*").alias("n"))


@query(
    "keyword_fraction",
    """SELECT round(sum(CASE WHEN lower(text) LIKE '%ation%' OR lower(text) LIKE '%eau%' THEN 1 ELSE 0 END) / count(*), 3) AS fraction FROM documents""",
)
def keyword_fraction(t: Tables):
    return reports.keyword_fraction(t.documents, "text", ("ation", "eau"))


@query("top1_group", "SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source ORDER BY n DESC, source LIMIT 1")
def top1_group(t: Tables):
    return reports.ranked_groups(t.documents.where("lang = 'en'"), "source", k=1)


@query("top3_groups", f"{_C} SELECT oem_group, count(*) AS n FROM complaints WHERE oem_group IS NOT NULL GROUP BY oem_group ORDER BY n DESC, oem_group LIMIT 3")
def top3_groups(t: Tables):
    return reports.ranked_groups(Star(t).complaints.where("oem_group IS NOT NULL"), "oem_group", k=3)


@query("ranked_groups", f"{_I} SELECT investigation_type, count(*) AS n FROM investigations WHERE open_date >= {_TODAY} - 1825 GROUP BY 1")
def ranked_groups(t: Tables):
    rows = Star(t).investigations.where(reports.since_days(feeds.as_of(), 1825, "open_date"))
    return reports.ranked_groups(rows, "investigation_type")


@query(
    "distinct_list",
    f"""{_I} SELECT DISTINCT oem_group FROM investigations WHERE investigation_type = 'EA' AND status = 'open'
          AND lower(component_raw) LIKE '%bolt%' AND open_date <= DATE '2000-12-31'""",
)
def distinct_list(t: Tables):
    rows = Star(t).investigations.where(
        (F.col("investigation_type") == "EA")
        & (F.col("status") == "open")
        & reports.keyword_test("component_raw", all_of=("bolt",))
        & (F.col("open_date") <= F.lit("2000-12-31").cast("date"))
    )
    return rows.select("oem_group").distinct()


@query("small_measure_count", f"{_R} SELECT count(*) AS n FROM recalls WHERE year(event_date) = 1999 AND units_affected < 20000")
def small_measure_count(t: Tables):
    rows = Star(t).recalls_fact.where(reports.in_year(F.lit(1999)) & (F.col("units_affected") < 20000))
    return rows.agg(F.count("*").alias("n"))


@query(
    "point_lookup",
    """WITH asked AS (SELECT DISTINCT l_partkey::VARCHAR AS part_id FROM lineitem UNION SELECT DISTINCT 'x' || l_suppkey FROM lineitem UNION SELECT DISTINCT repeat('9', 65) || l_suppkey FROM lineitem)
       SELECT part_id, p_partkey IS NOT NULL AS found, p_name, p_brand, CASE WHEN length(part_id) > 64 THEN 'id too long' END AS reason FROM asked LEFT JOIN part ON p_partkey::VARCHAR = part_id""",
)
def point_lookup(t: Tables):
    """Every id asked for comes back once, found or not."""
    asked = t.lineitem.select(F.col("l_partkey").cast("string").alias("part_id")).union(
        t.lineitem.select(F.explode(F.array(F.lit("x"), F.lit("9" * 65))).alias("head"), "l_suppkey").select(
            F.concat("head", F.col("l_suppkey").cast("string"))
        )
    )
    parts = t.part.withColumnRenamed("p_partkey", "part_id")
    return lookup(asked, parts, "part_id", ["p_name", "p_brand"])
