"""WARC archives in Zstandard: one frame per record, after a skippable frame that holds the archive's dictionary.

Writing. Of payloads with equal digests (of ``min_bytes`` bytes or more) the row with the largest id becomes a ``response`` record
with the whole payload, the others become ``revisit`` records that refer to it and hold the HTTP head only. Which row
that is comes from sums per digest, which combine before the shuffle; payloads are shuffled once, after the copies of each task
are gone. Each task makes one archive: it trains a dictionary on its first ``sample_bytes`` of payload, puts it into
the leading skippable frame and compresses record by record. Spark's own writer and committer store the bytes, on
any file system it knows, so a lost or repeated task leaves no half archive. It ends each row with a separator, for which
an empty skippable frame is used: every reader of the format skips it.

Reading. Archives from anywhere are read, one per row (2 GB at most, Spark's limit for a binary file), the frames one by one:
memory holds one archive and one record. Every record is checked: version line, mandatory headers, block length against
``Content-Length``, the closing blank lines, the HTTP length and the SHA-1 digest of the payload, the reference of a revisit.
What is wrong stands in ``problem``; a damaged frame gives one row with its offset, and reading stops there.

Defined results: a NULL payload is empty; empty payloads are equal to each other; a NULL id comes after all others
and reads back as NULL; of rows with the same id and payload one is the response (the first by address); an empty table
gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

DATE = "2024-01-01T00:00:00Z"
_ID = "urn:x-page:"
_FEED = 1 << 16


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """``id``, ``uri``, ``n_bytes``, ``digest`` (hex SHA-1), ``kind``, ``refers_to`` and, for responses, ``payload``."""
    data = F.coalesce(pages[payload].cast("binary"), F.lit(b""))
    rows = pages.select(
        pages[page_id].alias("id"), pages[url].alias("uri"), F.length(data).cast("long").alias("n_bytes"),
        F.sha1(data).alias("digest"), data.alias("payload"),
    )
    thin = rows.drop("payload")
    nothing = F.lit(None).cast(pages.schema[page_id].dataType)
    own = rows.where(F.col("n_bytes") < min_bytes).withColumns({"kind": F.lit("response"), "refers_to": nothing})
    shared, thin = rows.where(F.col("n_bytes") >= min_bytes), thin.where(F.col("n_bytes") >= min_bytes)

    order = Window.partitionBy("digest").orderBy(F.col("id").desc_nulls_last(), F.col("uri").asc_nulls_first())
    first = shared.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    first = first.withColumns({"kind": F.lit("response"), "refers_to": nothing})

    held = thin.groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("copies")).where("copies > 1")
    again = thin.join(held.select("digest", "top"), "digest")
    same = F.col("id").eqNullSafe(F.col("top"))
    by_address = Window.partitionBy("digest").orderBy(F.col("uri").asc_nulls_first())
    twice = again.where(same).withColumn("n", F.row_number().over(by_address)).where("n > 1").drop("n")
    revisits = again.where(~same).unionByName(twice).withColumnRenamed("top", "refers_to")
    revisits = revisits.withColumns({"kind": F.lit("revisit"), "payload": F.lit(None).cast("binary")})
    names = ["id", "uri", "n_bytes", "digest", "kind", "refers_to", "payload"]
    parts = [own] if min_bytes else []
    records = first.select(names)
    for part in (*parts, revisits):
        records = records.unionByName(part.select(names))
    return records


def base32_digest(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_bytes(row: dict, date: str = DATE) -> bytes:
    """One WARC record as it stands in its frame."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["n_bytes"]
    block += row["payload"] or b""
    name = lambda value: "null" if value is None else quote(str(value), safe="")
    headers = [
        ("WARC-Type", row["kind"]), ("WARC-Record-ID", f"<{_ID}{name(row['id'])}>"), ("WARC-Date", date),
        ("WARC-Target-URI", None if row["uri"] is None else row["uri"].replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", "sha1:" + base32_digest(row["digest"])),
        ("WARC-Profile", PROFILE if row["kind"] == "revisit" else None),
        ("WARC-Refers-To", f"<{_ID}{name(row['refers_to'])}>" if row["kind"] == "revisit" else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary, or nothing where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(
    records: DataFrame, path: str, level: int = 6, sample_bytes: int = 1 << 20, dictionary_bytes: int = 1 << 15
) -> None:
    """One archive per partition of ``records`` (columns as from :func:`plan_records`) under ``path``."""
    small_batches(records.sparkSession)
    names = ["id", "uri", "n_bytes", "digest", "kind", "refers_to", "payload"]

    def frames(batches) -> Iterator[pa.RecordBatch]:
        first: list[dict] | None = []
        seen, compress = 0, None

        def begin() -> bytes:
            nonlocal compress
            data = train_dictionary([r["payload"][:sample_bytes] for r in first if r["payload"]], dictionary_bytes)
            shared = zstandard.ZstdCompressionDict(data) if data else None
            compress = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True, write_content_size=True).compress
            return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data if data else EMPTY_FRAME

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64).to_pylist()
                out = []
                if first is not None:
                    first += rows
                    seen += sum(len(r["payload"] or b"") for r in rows)
                    if seen < sample_bytes:
                        continue
                    out, rows, done = [begin()], first, True
                    first = None if done else first
                yield frame_batch(out + [compress(record_bytes(r)) for r in rows])
        if first:
            head = begin()
            yield frame_batch([head] + [compress(record_bytes(r)) for r in first])

    def frame_batch(values: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["frame"])

    framed = records.select(names).mapInArrow(frames, "frame binary")
    framed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME.decode("ascii")).text(path)


class Archive:
    """The records of one archive's bytes, one frame at a time."""

    def __init__(self, data, max_record_bytes: int = 1 << 31):
        self.data, self.at, self.limit = memoryview(data), 0, max_record_bytes
        dictionary = b""
        if len(self.data) >= 8 and struct.unpack_from("<I", self.data)[0] == DICTIONARY_MAGIC:
            size = struct.unpack_from("<I", self.data, 4)[0]
            if 8 + size > len(self.data):
                raise ValueError("the dictionary frame is cut off")
            dictionary, self.at = bytes(self.data[8 : 8 + size]), 8 + size
            if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):
                dictionary = zstandard.ZstdDecompressor().decompress(dictionary, max_output_size=1 << 27)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.decompressor = zstandard.ZstdDecompressor(dict_data=shared)

    def frames(self) -> Iterator[tuple[int, bytes]]:
        """(offset, content) of each data frame."""
        while self.at < len(self.data):
            if self.at + 8 > len(self.data):
                raise ValueError("the archive ends inside a frame head")
            magic, size = struct.unpack_from("<II", self.data, self.at)
            if magic in SKIPPABLE:
                self.at += 8 + size
                continue
            if magic != FRAME_MAGIC:
                raise ValueError(f"no frame begins here: {magic:#x}")
            offset, unit, parts, length = self.at, self.decompressor.decompressobj(), [], 0
            while not unit.eof:
                piece = self.data[self.at : self.at + _FEED]
                if not piece:
                    raise ValueError("the archive ends inside a frame")
                parts.append(unit.decompress(piece))
                length += len(parts[-1])
                if length > self.limit:
                    raise ValueError(f"a record is longer than {self.limit} bytes")
                self.at += len(piece) - len(unit.unused_data)
            yield offset, b"".join(parts)


def parse_record(data: bytes) -> dict:
    """Headers and payload of a record, and the first ``problem`` found."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    found = {"headers": headers, "payload": b"", "payload_bytes": None, "problem": None}
    length = headers.get("content-length", "")
    if not blank or not lines[0].startswith("WARC/1."):
        found["problem"] = "no WARC head"
    elif missing := [h for h in MANDATORY if not headers.get(h)]:
        found["problem"] = f"missing header {missing[0]}"
    elif not length.isdigit() or int(length) + 4 != len(rest):
        found["problem"] = f"Content-Length is {length}, the block has {max(len(rest) - 4, 0)} bytes"
    elif rest[-4:] != b"\r\n\r\n":
        found["problem"] = "the record does not end in two blank lines"
    if found["problem"]:
        return found
    http, blank, payload = rest[:-4].partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")[1:])}
    stated = fields.get(b"content-length", b"")
    found |= {"payload": payload, "payload_bytes": int(stated) if stated.isdigit() else None}
    digest, kind = headers.get("warc-payload-digest", ""), headers["warc-type"]
    if not http.startswith(b"HTTP/") or not blank:
        found["problem"] = "no HTTP head"
    elif found["payload_bytes"] is None:
        found["problem"] = "no HTTP Content-Length"
    elif kind == "response" and found["payload_bytes"] != len(payload):
        found["problem"] = f"HTTP Content-Length is {found['payload_bytes']}, the payload has {len(payload)} bytes"
    elif kind == "response" and digest != "sha1:" + base32_digest(hashlib.sha1(payload).hexdigest()):
        found["problem"] = "the payload's digest differs"
    elif kind == "revisit" and not headers.get("warc-refers-to"):
        found["problem"] = "a revisit without a reference"
    return found


def named_id(value: str | None) -> str | None:
    """The id inside ``<urn:x-page:...>``."""
    if not value or not value.startswith(f"<{_ID}"):
        return None
    name = value[len(_ID) + 1 : -1]
    return None if name == "null" else unquote(name)


_READ = (
    "archive string, offset bigint, id string, uri string, record_type string, refers_to string, payload_bytes bigint, "
    "payload_digest string, payload binary, problem string"
)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [c.split()[0] for c in _READ.split(", ")]
    kinds = [{"bigint": pa.int64(), "binary": pa.binary()}.get(c.split()[1], pa.string()) for c in _READ.split(", ")]

    def rows(name: str, content) -> Iterator[tuple]:
        archive = None
        try:
            archive = Archive(content)
            for offset, data in archive.frames():
                r = parse_record(data)
                h, digest = r["headers"], r["headers"].get("warc-payload-digest", "")
                yield (
                    name, offset, named_id(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"),
                    named_id(h.get("warc-refers-to")), r["payload_bytes"], digest.removeprefix("sha1:") or None,
                    r["payload"] if with_payload else None, r["problem"],
                )
        except (ValueError, zstandard.ZstdError) as error:
            yield (name, archive.at if archive else 0, *[None] * 7, f"damaged: {error}")

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_buffer()
                held, size = [], 0
                for row in rows(batch.column(0)[i].as_py(), content):
                    held.append(row)
                    size += len(row[8] or b"") + 200
                    if size >= 8 << 20:
                        yield packed(held)
                        held, size = [], 0
                if held:
                    yield packed(held)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names
        )

    return files.mapInArrow(read, _READ)
