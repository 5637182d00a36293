"""Deterministic surrogate keys.

The fixed formulas below must stay as they are: tables built at different times join on them.
NULL counts as the empty string, so dimensions have to fold NULL into '' *before* they look
for distinct rows (``plans.star`` does), or two dimension rows would share one key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_GROUP = "UNKNOWN"


def _text(name: str, missing: str = "") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(missing))


def vehicle_key(make: str = "make_norm", model: str = "model_norm", year: str = "model_year") -> Column:
    return F.xxhash64(_text(make), _text(model), _text(year))


def component_id(group: str = "component_group", leaf: str = "component_leaf") -> Column:
    return F.xxhash64(_text(group), _text(leaf))


def oem_group_id(group: str = "oem_group") -> Column:
    return F.xxhash64(_text(group, UNKNOWN_GROUP))


def chunk_id(dataset: Column, source_id: Column, idx: Column, variant: Column | None = None) -> Column:
    """Id of a chunk; ``variant`` tells further texts under the same source id apart and is mostly NULL."""
    parts = [dataset, F.coalesce(source_id, F.lit("")), idx.cast("string")]
    return F.sha2(F.concat_ws("::", *parts, *([] if variant is None else [variant])), 256)


def document_id(action: Column, url: Column) -> Column:
    return F.concat(action, F.lit("__"), F.substring(F.sha1(url), 1, 16))


def content_hash(*columns: str) -> Column:
    """Change detection over a row: every column as JSON, NULLs included, then SHA-256."""
    body = F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def content_bits(*columns: str) -> tuple[Column, Column]:
    """Change detection over a row as two 64-bit numbers, which aggregate without sorting."""
    body = F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})
    return F.xxhash64(body), F.xxhash64(F.lit(1), body)
