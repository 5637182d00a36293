"""ZIP archives as a data source: one member per archive, streamed by the executors from open files."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .flat_files import parse_records
from .records import join_lines

# Archive name fragment -> member name fragment, tried in this order.
MEMBER_BY_ARCHIVE = (("mfr_comms_received", "MFR_COMMS"), ("tsbs_received", "TSBS_RECEIVED"))
DEFAULT_MEMBER = "FLAT_TSB"
#: Bytes inflated at a time.
PIECE = 1 << 20


def member_for(archive_name: str) -> str:
    low = archive_name.lower()
    return next((member for key, member in MEMBER_BY_ARCHIVE if key in low), DEFAULT_MEMBER)


def open_file(path: str):
    """A seekable file by path or URI; other file systems are those that Arrow knows."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):", path)
    if not scheme or scheme[1] == "file":
        return open(re.sub(r"\Afile:/*(?=/)", "", path), "rb")
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


def inflated_lines(raw, piece: int = PIECE) -> Iterator[bytes]:
    """Lines with their line breaks, inflated piece by piece."""
    rest: list[bytes] = []
    while data := raw.read(piece):
        first, *others = data.split(b"\n")
        rest.append(first)
        if others:
            yield b"".join(rest) + b"\n"
            yield from (line + b"\n" for line in others[:-1])
            rest = [others[-1]]
    if any(rest):
        yield b"".join(rest)


@dataclass
class Archive(InputPartition):
    path: str


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["archives"])
        self.member = options.get("member")
        self.sep = options.get("sep", "\t").encode()
        self.per_batch = int(options.get("perbatch", 20_000))

    def partitions(self) -> list[Archive]:
        return [Archive(p) for p in self.paths]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        path = partition.path
        wanted = (self.member or member_for(path.rsplit("/", 1)[-1])).lower()
        with open_file(path) as file, zipfile.ZipFile(file) as archive:
            name = next((n for n in archive.namelist() if wanted in n.lower()), None)
            if name is None:
                raise FileNotFoundError(f"no member like {wanted!r} in {path}")
            with archive.open(name) as raw:
                start, held = 0, []
                for record in join_lines(inflated_lines(raw), self.sep):
                    held.append(record.decode("latin-1"))
                    if len(held) == self.per_batch:
                        yield _batch(path, start, held)
                        start, held = start + len(held), []
                if held:
                    yield _batch(path, start, held)


class ZipRecords(DataSource):
    """``spark.read.format("zip_records")``: ``archive``, ``line_no``, ``line``; options ``archives`` (JSON list), ``member``, ``sep``, ``perBatch``."""

    @classmethod
    def name(cls) -> str:
        return "zip_records"

    def schema(self) -> str:
        return "archive string, line_no bigint, line string"

    def reader(self, schema) -> ZipReader:
        return ZipReader({k.lower(): v for k, v in self.options.items()})


def _batch(path: str, start: int, lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * n), pa.array(range(start, start + n), pa.int64()), pa.array(lines, pa.string())],
        names=["archive", "line_no", "line"],
    )


def read_zip_lines(
    spark: SparkSession, paths: str | list[str], member: str | None = None, lines_per_batch: int = 20_000, sep: str = "\t"
) -> DataFrame:
    """``(archive, line_no, line)`` of the first member whose name holds ``member``, any case; a line is a record, its quoted fields may hold line breaks.

    One task reads one archive, as a ZIP stream cannot be split. The file is opened where it lies and the member inflated in pieces, so
    memory does not depend on the archive's size. Records are spread over the cluster right after, so
    that parsing does not stay in as many tasks as there are archives. Archives without such a
    member are an error. Spark lists the files, which may be folders or patterns on any of its file systems; executors must be able to open
    them by path, or by a URI that Arrow knows.
    """
    spark.dataSource.register(ZipRecords)
    listed = spark.read.format("binaryFile").load(paths).select("path").toLocalIterator()
    archives = sorted(r["path"] for r in listed)
    options = {"archives": json.dumps(archives), "sep": sep, "perBatch": str(lines_per_batch)} | ({"member": member} if member else {})
    return spark.read.format("zip_records").options(**options).load().hint("rebalance")


def parse_lines(lines: DataFrame, columns: tuple[str, ...], sep: str = "\t", overflow: bool = True) -> DataFrame:
    """Delimited lines as columns, see :func:`.flat_files.parse_records`."""
    return parse_records(lines, "line", columns, sep, overflow)
