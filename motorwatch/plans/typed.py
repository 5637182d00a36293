"""Typed tables from the all-text raw feeds.

Each table is a layout, ``output column: (rule, feed field)``, applied by one function; what does
not fit a rule (the state of an investigation, drifting crash snapshots) is added around it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import any_date, automation_level, compact_date, lenient_int, lenient_long, yes_flag
from ..functions.privacy import mask_personal
from ..functions.text import component_group, component_leaf
from ..sources.taxonomy import DEFAULT_TAXONOMY, Taxonomy, resolve_make

# Rule -> (expression over a feed field, type when the feed lacks the field).
_RULES: dict[str, tuple[Callable[[str], Column], str]] = {
    "text": (lambda c: F.col(c).cast("string"), "string"),
    "int": (lenient_int, "int"),
    "long": (lenient_long, "bigint"),
    "flag": (yes_flag, "boolean"),
    "group": (component_group, "string"),
    "leaf": (component_leaf, "string"),
    "masked": (mask_personal, "string"),
    "length": (F.length, "int"),
    "prefix": (lambda c: F.substring(c, 1, 2), "string"),
}

# Layouts of the typed tables.
RECALLS = {
    "record_id": ("text", "record_id"),
    "campaign_number": ("text", "campno"),
    "mfr_campaign_number": ("text", "mfgcampno"),
    "make_norm": ("make", ""),
    "oem_group": ("make", ""),
    "model_norm": ("text", "modeltxt"),
    "model_year": ("int", "yeartxt"),
    "component_raw": ("text", "compname"),
    "component_group": ("group", "compname"),
    "component_leaf": ("leaf", "compname"),
    "recall_type_code": ("text", "rcltypecd"),
    "units_affected": ("long", "potaff"),
    "owner_notify_date": ("date", "odate"),
    "record_creation_date": ("date", "rcdate"),
    "manufacture_begin_date": ("date", "bgman"),
    "manufacture_end_date": ("date", "endman"),
    "fmvss": ("text", "fmvss"),
    "defect_description": ("text", "desc_defect"),
    "consequence_description": ("text", "conequence_defect"),
    "corrective_action": ("text", "corrective_action"),
    "notes": ("text", "notes"),
}
COMPLAINTS = {
    "complaint_id": ("text", "cmplid"),
    "odi_number": ("text", "odino"),
    "make_norm": ("make", ""),
    "oem_group": ("make", ""),
    "model_norm": ("text", "modeltxt"),
    "model_year": ("int", "yeartxt"),
    "component_raw": ("text", "compdesc"),
    "component_group": ("group", "compdesc"),
    "component_leaf": ("leaf", "compdesc"),
    "incident_date": ("date", "faildate"),
    "loaded_date": ("date", "ldate"),
    "amend_date": ("date", "datea"),
    "crash": ("flag", "crash"),
    "fire": ("flag", "fire"),
    "injured": ("int", "injured"),
    "deaths": ("int", "deaths"),
    "miles": ("long", "miles"),
    "city": ("text", "city"),
    "state": ("text", "state"),
    "narrative_clean": ("masked", "cdescr"),
    "narrative_len_orig": ("length", "cdescr"),
    "complaint_source": ("text", "cmpl_type"),
}
INVESTIGATIONS = {
    "nhtsa_action_number": ("text", "nhtsa_action_number"),
    "investigation_type": ("prefix", "nhtsa_action_number"),
    "subject": ("text", "subject"),
    "summary": ("text", "summary"),
    "linked_campaign_number": ("text", "campno"),
    "mfr_norm": ("make", ""),
    "oem_group": ("make", ""),
    "make_raw": ("text", "maketxt"),
    "model_norm": ("text", "modeltxt"),
    "model_year": ("int", "yeartxt"),
    "component_raw": ("text", "component_name"),
    "component_group": ("group", "component_name"),
    "open_date": ("date", "action_open_date"),
    "close_date": ("date", "action_close_date"),
}
BULLETINS = {
    "tsb_id": ("text", "tsb_id"),
    "nhtsa_item_number": ("text", "nhtsa_item_number"),
    "replacement_bulletin_no": ("text", "replacement_bulletin_no"),
    "make_norm": ("make", ""),
    "oem_group": ("make", ""),
    "model_norm": ("text", "modeltxt"),
    "model_year": ("int", "yeartxt"),
    "component_raw": ("text", "component_desc"),
    "component_group": ("group", "component_desc"),
    "mfr_component_system": ("text", "mfr_component_system"),
    "mfr_component_subsystem": ("text", "mfr_component_subsystem"),
    "communication_type": ("text", "communication_type"),
    "summary": ("text", "summary"),
    "original_date": ("date", "orig_date"),
    "changed_date": ("date", "changed_date"),
    "bulletin_year": ("year", "orig_date"),
}


def _apply(df: DataFrame, layout: dict[str, tuple[str, str]], as_of: Column | None) -> list[Column]:
    """The columns of a layout; a field the feed lacks gives a typed NULL."""
    rules = {
        **_RULES,
        "date": (lambda c: compact_date(c, as_of), "date"),
        "year": (lambda c: F.year(compact_date(c, as_of)), "int"),
    }
    out = []
    for name, (rule, field) in layout.items():
        if rule == "make":  # made by resolve_make under its final name
            out.append(F.col(name))
            continue
        express, kind = rules[rule]
        out.append((express(field) if field in df.columns else F.lit(None).cast(kind)).alias(name))
    return out


def _stamps(df: DataFrame) -> list[Column]:
    """When the raw row was taken in, where known, and when it was typed."""
    taken = F.col("_ingested_at") if "_ingested_at" in df.columns else F.lit(None).cast("timestamp")
    return [taken.alias("_bronze_ingested_at"), F.current_timestamp().alias("_silver_at")]


def recalls(raw: DataFrame, as_of: Column | None = None, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    df = resolve_make(raw, "maketxt", taxonomy)
    return df.select(*_apply(df, RECALLS, as_of), *_stamps(df))


def complaints(raw: DataFrame, as_of: Column | None = None, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Typed complaints; narratives are masked here and nowhere later."""
    df = resolve_make(raw, "maketxt", taxonomy)
    return df.select(*_apply(df, COMPLAINTS, as_of), *_stamps(df))


def bulletins(raw: DataFrame, as_of: Column | None = None, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    df = resolve_make(raw, "maketxt", taxonomy)
    return df.select(*_apply(df, BULLETINS, as_of), *_stamps(df))


def investigations(
    raw: DataFrame,
    as_of: Column | None = None,
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
    resolve_from: str = "maketxt",
) -> DataFrame:
    """Typed investigations with their state.

    The group is resolved from the make: the manufacturer's legal name (``resolve_from=
    "mfr_name"``) is not in any taxonomy of makes. Open cases count their days up to ``as_of``.
    """
    today = F.current_date() if as_of is None else as_of
    df = resolve_make(raw, resolve_from, taxonomy, make="mfr_norm")
    dated = df.select(*_apply(df, INVESTIGATIONS, as_of), *_stamps(df))
    state = [
        F.datediff(F.coalesce("close_date", today), "open_date").alias("days_open"),
        F.when(F.col("close_date").isNull(), F.lit("open")).otherwise(F.lit("closed")).alias("status"),
    ]
    return dated.select(*INVESTIGATIONS, *state, "_bronze_ingested_at", "_silver_at")


def av_crashes(
    raw: DataFrame,
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
    *,
    key: str = "report_id",
    make: str = "make",
    level: str = "sae_automation_level",
    date: str = "incident_date",
) -> DataFrame:
    """All snapshot columns plus normalised ones; a column the snapshot lacks gives typed NULLs."""
    if key not in raw.columns:
        raise ValueError(f"crash snapshot lacks its key column {key!r}; it has {sorted(raw.columns)}")
    have = set(raw.columns)
    nothing = F.lit(None)
    if make in have:
        df = resolve_make(raw, make, taxonomy)
    else:
        df = raw.withColumns({"make_norm": nothing.cast("string"), "oem_group": nothing.cast("string")})
    return df.withColumns(
        {
            "sae_level": automation_level(level) if level in have else nothing.cast("string"),
            "incident_date_d": any_date(date) if date in have else nothing.cast("date"),
            "_silver_at": F.current_timestamp(),
        }
    )
