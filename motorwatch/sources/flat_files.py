"""Delimited files: headerless positional feeds, and header CSVs whose columns drift."""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import header_name
from .records import ASCII_BASED, decoded, has_breaks, read_records, split_states

_RAW = "_raw_line"
OVERFLOW = "_overflow"


def _outside_quotes(sep: str) -> str:
    """The separator, only where an even number of quotes follows up to the end of the line."""
    escaped = "\\t" if sep == "\t" else f"\\Q{sep}\\E"
    return rf'{escaped}(?=(?:[^"]*"[^"]*")*[^"]*\z)'


def _unquote(field: Column) -> Column:
    inner = F.regexp_extract(field, r'(?s)\A"(.*)"\z', 1)
    return F.when(field.rlike(r'(?s)\A".*"\z'), F.regexp_replace(inner, '""', '"')).otherwise(field)


def overflow_fields(line: Column, known: int, sep: str = "\t") -> Column:
    """The fields of a raw line past the ``known`` ones, NULL where there are none."""
    parts = F.split(line, _outside_quotes(sep))
    return F.when(F.size(parts) > known, F.transform(F.slice(parts, known + 1, F.size(parts)), _unquote))


def has_values(columns: tuple[str, ...], overflow: bool) -> Column:
    """True for rows with any value, in a known column or past them."""
    filled = F.coalesce(*[F.col(c) for c in columns]).isNotNull()
    return filled | F.exists(F.coalesce(F.col(OVERFLOW), F.array()), lambda x: x != "") if overflow else filled


def parse_records(rows: DataFrame, record: str, columns: tuple[str, ...], sep: str = "\t", overflow: bool = True) -> DataFrame:
    """Delimited records, one text each, as columns: short ones end in NULL, those without any value are dropped.

    With ``overflow`` fields past the known columns come back whole in ``_overflow``.
    """
    ddl = ", ".join(f"`{c}` string" for c in columns)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "lineSep": "\n"}
    parsed = rows.where(F.col(record) != "").select(F.from_csv(record, ddl, options).alias("r"), record)
    extra = [overflow_fields(F.col(record), len(columns), sep).alias(OVERFLOW)] if overflow else []
    return parsed.select("r.*", *extra).where(has_values(columns, overflow))


def read_flat(
    spark: SparkSession,
    paths: str | list[str],
    columns: tuple[str, ...],
    *,
    sep: str = "\t",
    encoding: str = "ISO-8859-1",
    overflow: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Headerless delimited text with known column order, every column a string.

    Short rows are padded with NULL, rows without any value are dropped, and empty fields read
    as NULL. With ``overflow`` the fields past the last known column come back whole in
    ``_overflow``; they are re-split from the raw line, and only for the lines that have more
    fields than columns. Quoted fields may hold line breaks: the files are looked through once, and where
    a record goes over a line's end, lines are joined (:mod:`.records`); files stay splittable. Without
    ``multi_line`` the caller knows that there are none. Other encodings than those of
    ``ASCII_BASED`` make each file one task.
    """
    whole_files = multi_line and encoding.upper() not in ASCII_BASED
    if multi_line and not whole_files:
        states = split_states(spark, paths, sep)
        if has_breaks(states):
            return parse_records(read_records(spark, paths, sep, encoding, states), "record", columns, sep, overflow)
    fields = [T.StructField(name, T.StringType(), True) for name in columns]
    reader = (
        spark.read.option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", encoding)
        .option("multiLine", whole_files)
        .option("mode", "PERMISSIVE")
    )
    if not overflow:
        frame = reader.schema(T.StructType(fields)).csv(paths)
    else:
        with_raw = T.StructType([*fields, T.StructField(_RAW, T.StringType(), True)])
        frame = (
            reader.option("columnNameOfCorruptRecord", _RAW)
            .option("columnPruning", False)
            .schema(with_raw)
            .csv(paths)
        )
        frame = frame.withColumn(OVERFLOW, overflow_fields(F.col(_RAW), len(columns), sep)).drop(_RAW)
    return frame.where(has_values(columns, overflow))


def read_csv_snapshots(
    spark: SparkSession, paths: list[str], *, tag: str = "_sgo_source", encoding: str = "UTF-8"
) -> DataFrame:
    """Header CSV snapshots with overlapping columns as one frame.

    Header names are normalised (of two that become equal the last one counts), empty values
    are NULL, each row carries its file's name, and the columns are the union over all snapshots
    in the order of ``paths``. One job finds the headers, and whether quoted fields hold line
    breaks; files with equal headers are read together, so the plan grows with the number of
    different headers only.
    """
    states = split_states(spark, paths, ",", heads=True)
    heads = states.where("head is not null").select("path", decoded(F.col("head"), encoding).alias("head"))
    files: dict[tuple[str, ...], list[str]] = {}
    listed = sorted(((r["path"], r["head"]) for r in heads.toLocalIterator()), key=lambda x: _place(x[0], paths))
    for path, head in listed:
        files.setdefault(tuple(next(csv.reader(io.StringIO(head)), [])), []).append(path)
    broken = has_breaks(states)
    rows = read_records(spark, paths, ",", encoding, states).where("not first") if broken else None

    def one(header: tuple[str, ...], of: list[str]) -> DataFrame:
        ddl = ", ".join(f"`c{i}` string" for i in range(len(header)))
        options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
        if broken:
            mine = rows.join(F.broadcast(spark.createDataFrame([(p,) for p in of], "path string")), "path", "left_semi").where("record <> ''")
            raw = mine.select(F.from_csv("record", ddl, {**options, "multiLine": "true", "lineSep": "\n"}).alias("r"), "path").select("r.*", "path")
        else:
            raw = spark.read.schema(ddl).options(header=True, encoding=encoding, **options).csv(of).withColumn("path", F.col("_metadata.file_path"))
        by_name = {header_name(c): f"c{i}" for i, c in enumerate(header)}
        values = [F.nullif(F.col(old), F.lit("")).alias(new) for new, old in by_name.items()]
        return raw.select(*values, F.element_at(F.split("path", "/"), -1).alias(tag))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(h, of) for h, of in files.items()])


def _place(path: str, paths: list[str]) -> tuple[int, str]:
    """Where a file belongs in the order in which files and folders were asked for."""
    plain = [p.rstrip("/").split(":", 1)[-1].lstrip("/") for p in paths]
    mine = path.split(":", 1)[-1].lstrip("/")
    return next((i for i, p in enumerate(plain) if mine == p or mine.startswith(p + "/")), len(paths)), path
