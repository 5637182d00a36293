"""Removal of byte strings that occur twice, by hash grouping of minimizer units and of suffixes at a difference cover.

Every byte that lies in a ``length``-byte string which also starts anywhere else, in the same text or in another, is removed from all
places. Texts are UTF-8 bytes; matches do not cross texts.

A suffix sort of all bytes would shuffle each of them many times over. Nothing is sorted, ranked or compared with a neighbour here: only
suffixes that can have an equal are looked at, and equal ones are found by grouping hashes:

1. *Pruning without loss.* Of the ``kmer``-byte strings that start in the first ``length - kmer + 1`` bytes of a ``length``-byte window the
   one with the least hash is its minimizer. Equal windows have equal minimizers. Neighbouring windows that share one are a *unit* (a
   hundred windows at most). A unit whose content occurs twice is removed whole; one whose minimizer
   occurs nowhere else is kept whole. The open ones, same minimizer but different content, go on: two or three percent of the bytes.
   Equal units of one text, as a line repeated in it makes, are counted where they are found and go on as one row.
2. *Names.* The name of a string is a hash of the triple of the names of its thirds, down to single bytes. Ranks from a sort would do
   the same at one shuffle per level; hashed names cost none, and equal strings still come together, which is all that is asked.
3. *Difference cover.* Of the suffixes of open units those at positions in a difference cover modulo ``PERIOD`` are sampled, and brought
   together by the name of their first ``length - PERIOD + 1`` bytes. For any two suffixes some shift below ``PERIOD`` leads both to sampled
   positions, so equal windows have equal sampled suffixes inside. Sampled suffixes without an equal are discarded.
4. *In place of merging.* The remaining suffixes, those with a sampled repeat less than ``PERIOD`` bytes ahead, come together by the name of
   their whole prefix of ``length`` bytes. Those whose name occurs again are marked.

Bringing together is a hash aggregation, which combines before the shuffle: a passage in a third of all texts is no hot task as it would be in a
sorted range. Units are taken as equal if 128 bits agree (minimizer and content), suffixes of open ones
if 96 do (half of the minimizer, and the name).

Defined results: a NULL text is empty; texts shorter than ``length`` keep everything; each of several equal texts of at least
``length`` bytes loses all bytes; repeated rows count as texts of their own; extra columns are kept in ``row``; no documents give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stages, small_batches, text_key, whole_row

LENGTH = 400
KMER = 300
#: A difference cover: each number modulo 73 is the difference of two of these nine.
PERIOD = 73
COVER = (0, 1, 3, 7, 15, 31, 36, 54, 63)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, size=256, dtype=np.uint64)
#: Bytes worked on at a time, and the longest piece of one text.
_BLOCK, _CHUNK = 1 << 16, 1 << 20
_PLACE_BITS = np.uint64(21)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def need(self, n: int) -> None:
        while len(self.up) < n:
            step = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_P, step, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_P_INVERSE, step, 1 << 64))])


def prefix_sums(data: bytes, powers: Powers) -> np.ndarray:
    """Sums of byte values times falling powers: all window hashes are differences of two of them."""
    powers.need(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[np.frombuffer(data, dtype=np.uint8)] * powers.down[: len(data)], out=out[1:])
    return out


def window_hashes(sums: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """A polynomial hash of each ``length`` consecutive bytes."""
    n = len(sums) - length
    return (sums[length:] - sums[:n]) * powers.up[:n]


def minimizer_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` consecutive hashes the place of the one with the least upper bits, the first of equal ones."""
    order = hashes ^ (hashes >> np.uint64(32))
    order *= np.uint64(0xD6E8FEB86659FD93)
    order >>= _PLACE_BITS
    order <<= _PLACE_BITS
    order |= np.arange(len(order), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        order = np.minimum(order[:-size], order[size:])
        size *= 2
    n, rest = len(hashes) - width + 1, width - size
    least = np.minimum(order[:n], order[rest : rest + n])
    return (least & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)


def units_of(parts: list[bytes], length: int, kmer: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Of each unit of the parts: the part's number, minimizer hash, content hash, first window and window after the last."""
    data, sizes = b"".join(parts), np.array([len(p) for p in parts])
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 5
    sums = prefix_sums(data, powers)
    hashes, whole = window_hashes(sums, kmer, powers), window_hashes(sums, length, powers)
    place = minimizer_places(hashes, length - kmer + 1)
    offsets = np.cumsum(sizes) - sizes
    holds = sizes >= length
    first, after = offsets[holds], (offsets + sizes - length + 1)[holds]
    inside = np.zeros(len(place) + 1, dtype=np.int8)  # windows that do not run over the end of their part
    inside[first] += 1
    inside[after] -= 1
    opens = np.concatenate([[True], place[1:] != place[:-1]])
    opens[first] = True
    starts = np.flatnonzero(opens & (np.cumsum(inside[:-1]) > 0))
    part = np.searchsorted(first, starts, side="right") - 1
    stops = np.append(starts[1:], after[-1:])
    np.minimum(stops, after[part], out=stops)
    # A unit is shorter than a window, so its first and last window and their distance tell all of its content.
    content = mixed(mixed(whole[starts]) + whole[stops - 1] * np.uint64(3) + (stops - starts).astype(np.uint64))
    number, base = np.flatnonzero(holds)[part], first[part]
    return number, mixed(hashes[place[starts]]).view(np.int64), content.view(np.int64), starts - base, stops - base


def counted(node: np.ndarray, fp: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[tuple, tuple]:
    """Of units in the order of their texts, one row for those with the same node and content, ``n`` being their number;

    and the runs (node, first window, window after the last) that units cover whose content occurs again in their text."""
    order = np.lexsort((h, fp, node))
    heads = np.ones(len(order), dtype=bool)
    heads[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (node, fp, h)], axis=0)
    heads = np.flatnonzero(heads)
    n = np.diff(np.append(heads, len(order)))
    first, again = order[heads], np.sort(order[np.repeat(n > 1, n)])
    of, start, stop = node[again], a[again], b[again]
    opens = np.ones(len(again) + 1, dtype=bool)
    opens[1:-1] = (of[1:] != of[:-1]) | (start[1:] != stop[:-1])
    return (node[first], fp[first], h[first], a[first], b[first], n), (of[opens[:-1]], start[opens[:-1]], stop[opens[1:]])


def pieces_of(data: bytes, length: int) -> list[tuple[int, bytes]]:
    """(offset, piece): a very long text in pieces that overlap by all but one byte of a window, so that each window lies in one piece."""
    if len(data) <= _CHUNK + length:
        return [(0, data)]
    return [(at, data[at : at + _CHUNK + length - 1]) for at in range(0, len(data) - length + 1, _CHUNK)]


def blocks_of(rows: Iterator[tuple], length: int) -> Iterator[list[tuple]]:
    """(row, offset, piece) in groups of about ``_BLOCK`` bytes."""
    held, size = [], 0
    for row, data in rows:
        for at, piece in pieces_of(data, length):
            held.append((row, at, piece))
            size += len(piece)
            if size >= _BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def units(docs: DataFrame, text: str, length: int, kmer: int, tables: Stages) -> DataFrame:
    """The units of all texts of at least ``length`` bytes: ``node`` (a row of ``docs``), ``fp``, ``h``, ``a``, ``b`` and ``n``, as ``counted`` has them.

    Each such row also has one line with its ``key`` and no unit, and one of ``a`` and ``b`` alone for each run that repeats in it.
    """
    small_batches(docs.sparkSession)
    data = F.coalesce(docs[text], F.lit("")).cast("binary")
    rows = docs.select(data.alias("text"), text_key(docs[text]).alias("key")).where(F.octet_length("text") >= length)
    rows = rows.select(F.monotonically_increasing_id().alias("node"), "key", "text")
    names = ["node", "key", "fp", "h", "a", "b", "n"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def lines(**values):
        size = len(values["node"])
        arrays = [pa.array(values[c].astype(k.to_pandas_dtype()), k) if c in values else pa.nulls(size, k) for c, k in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches):
        powers = Powers()
        for batch in batches:
            count = batch.num_rows
            blank = [pa.nulls(count, k) for k in kinds[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *blank], names=names)
            texts = zip(batch.column(0).to_pylist(), (v.as_buffer().to_pybytes() for v in batch.column(2)), strict=True)
            for block in blocks_of(texts, length):
                number, fp, h, a, b = units_of([p for _, _, p in block], length, kmer, powers)
                node, at = np.array([r for r, _, _ in block])[number], np.array([o for _, o, _ in block])[number]
                found, runs = counted(node, fp, h, a + at, b + at)
                yield lines(**dict(zip(["node", "fp", "h", "a", "b", "n"], found, strict=True)))
                if len(runs[0]):
                    yield lines(**dict(zip(["node", "a", "b"], runs, strict=True)))

    return tables.keep(rows.mapInArrow(run, "node bigint, key string, fp bigint, h bigint, a int, b int, n int"), "units")


def names_of(data: bytes, length: int) -> np.ndarray:
    """The name of the ``length`` bytes from each position: triples of names of thirds, the last triple laid over the one before."""
    names = _BYTES[np.frombuffer(data, dtype=np.uint8)]
    size = 1
    while 3 * size <= length:
        n = len(names) - 2 * size
        triple = names[:n] * np.uint64(_P)
        triple += names[size : size + n] * np.uint64(0xC2B2AE3D27D4EB4F)
        triple += names[2 * size :] * np.uint64(0x165667B19E3779F9)
        names = mixed(triple)
        size *= 3
    n = len(data) - length + 1
    # What is longer than a power of three is named by as many overlapping names as cover it, again as a chain of hashes.
    out = names[:n]
    for at in [*range(size, length - size, size), length - size]:
        out = mixed(out * np.uint64(5) + names[at : at + n])
    return out


def open_units(docs: DataFrame, text: str, tests: DataFrame, length: int, tables: Stages) -> DataFrame:
    """``unit``, ``node``, ``a``, ``fp``, ``content`` of the units to be compared."""
    keyed = docs.select(text_key(docs[text]).alias("key"), docs[text].cast("binary").alias("text"))
    texts = keyed.join(tests, "key").dropDuplicates(["node"])
    content = F.expr(f"substring(text, u.a + 1, u.b - u.a + {length - 1})")
    rows = texts.select("node", "text", F.explode("wanted").alias("u")).select("node", "u.a", "u.fp", content.alias("content"))
    return tables.keep(rows.select(F.monotonically_increasing_id().alias("unit"), "*"), "open")


def named(units: DataFrame, length: int, pick, columns: list[str]) -> DataFrame:
    """``unit``, ``fp``, ``at``, ``name`` for the positions that ``pick`` chooses.

    ``pick`` gets the place of each byte in its unit, the units' offsets and the batch, and gives a mask.
    """

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                batch = whole.slice(lo, 128)
                contents = [v.as_buffer().to_pybytes() for v in batch.column(2)]
                sizes = np.array([len(c) for c in contents])
                offsets = np.cumsum(sizes) - sizes
                place = np.arange(sizes.sum()) - np.repeat(offsets, sizes)
                fits = place <= np.repeat(sizes, sizes) - length
                at = np.flatnonzero(fits & pick(place, offsets, batch))
                owner = np.searchsorted(offsets, at, side="right") - 1
                name = names_of(b"".join(contents), length)[at].view(np.int64) if len(at) else at
                unit, fp = (batch.column(i).to_numpy()[owner] for i in (0, 1))
                columns = ((unit, pa.int64()), (fp >> 32, pa.int32()), (place[at], pa.int32()), (name, pa.int64()))
                arrays = [pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=["unit", "fp", "at", "name"])

    return units.select("unit", "fp", "content", *columns).mapInArrow(run, "unit bigint, fp int, at int, name bigint")


def repeated(rows: DataFrame) -> DataFrame:
    """Per unit, ``places``: the positions whose name occurs again."""
    again = rows.groupBy("fp", "name").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(again, ["fp", "name"]).groupBy("unit").agg(F.collect_list("at").alias("places"))


def repeats_in(open: DataFrame, length: int, period: int, cover: tuple[int, ...], tables: Stages) -> DataFrame:
    """``node``, ``starts``: of every window inside the units that equals another one."""

    def sample(place: np.ndarray, offsets: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        return np.isin(np.arange(period), cover)[place % period]

    def near_sample(place: np.ndarray, offsets: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column(3)
        repeats, of = lists.flatten().to_numpy(), np.repeat(offsets, lists.value_lengths().to_numpy())
        ahead = np.zeros(len(place) + 1, dtype=np.int64)
        np.add.at(ahead, np.maximum(of + repeats - period + 1, of), 1)
        np.add.at(ahead, of + repeats + 1, -1)
        return np.cumsum(ahead[:-1]) > 0

    sampled = tables.keep(named(open, length - period + 1, sample, []), "sampled")
    near = tables.keep(named(open.join(repeated(sampled), "unit"), length, near_sample, ["places"]), "near")
    tables.drop("sampled")
    starts = F.transform("places", lambda at: F.col("a") + at)
    marked = tables.keep(open.select("unit", "node", "a").join(repeated(near), "unit").select("node", starts.alias("starts")), "starts")
    tables.drop("near")
    return marked


def repeated_spans(docs: DataFrame, text: str, length: int = LENGTH, kmer: int = KMER, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """What repeats in a text, by its ``key``: ``whole``, or ``spans`` (first window, window after the last) and single ``starts``."""
    tables = Stages(docs.sparkSession)
    small_batches(docs.sparkSession)
    found = units(docs, text, length, kmer, tables)
    lines = tables.keep(found.where("fp is null").select("node", "key", "a", "b"), "lines")
    keys, own = lines.where("key is not null").select("node", "key"), lines.where("key is null").select("node", "a", "b")
    texts = keys.groupBy("key").agg(F.min("node").alias("node"), F.count("*").alias("copies"))
    texts = tables.keep(texts, "texts")
    entries = found.where("fp is not null").drop("key")
    # Most minimizers occur once: they go by one aggregation that keeps no contents but the least and the greatest of each.
    per_fp = entries.groupBy("fp").agg(F.sum("n").alias("n"), F.min("h").alias("least"), F.max("h").alias("greatest")).where("n > 1")
    shared = tables.keep(per_fp.select("fp", (F.col("least") != F.col("greatest")).alias("open")), "shared")
    tables.drop()
    alike = tables.keep(entries.join(shared, "fp").select("node", "fp", "h", "a", "b", "n", "open"), "alike")
    tables.drop("units", "shared")
    opened = alike.where("open")
    # Written first, so that Spark sees a common content among the join's inputs and splits it.
    kinds = tables.keep(opened.groupBy("fp", "h").agg(F.sum("n").alias("n"), F.min("node").alias("first")), "kinds")
    columns = ["node", "fp", "h", "a", "b"]
    told = opened.drop("n").join(kinds, ["fp", "h"]).select(*columns, (F.col("n") > 1).alias("again"), (F.col("first") == F.col("node")).alias("test"))
    seen = told.where("again or test").union(alike.where("not open").select(*columns, F.lit(True), F.lit(False)))
    seen = tables.keep(seen, "seen")
    tables.drop("alike", "kinds")
    # Of equal contents one stands for all in the comparison.
    wanted = seen.where("test").dropDuplicates(["node", "fp", "h"]).groupBy("node").agg(F.collect_list(F.struct("a", "b", "fp")).alias("wanted"))
    wanted = tables.keep(wanted.join(keys, "node"), "wanted")
    open = open_units(docs, text, wanted, length, tables)
    tables.drop("wanted")
    starts = repeats_in(open, length, period, cover, tables)
    tables.drop("open")
    spans = seen.where("again").select("node", "a", "b").union(own).groupBy("node").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    starts = starts.groupBy("node").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    whole = F.col("copies") > 1
    every = texts.join(spans, "node", "left").join(starts, "node", "left").where(whole | F.col("spans").isNotNull() | F.col("starts").isNotNull())
    every = every.select("key", whole.alias("whole"), *[F.when(~whole, F.col(c)).alias(c) for c in ("spans", "starts")])
    every = tables.keep(every, "spans")
    tables.drop("texts", "lines", "seen", "starts")
    return every


_RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def inner(data: bytes, start: int, stop: int) -> bytes:
    """What lies between two cuts (or ends of the text), without the parts of characters that a cut has left at its borders."""
    if start:
        while start < stop and data[start] & 0xC0 == 0x80:
            start += 1
    if stop < len(data):
        lead = next((i for i in range(stop - 1, max(start, stop - 3) - 1, -1) if data[i] & 0xC0 != 0x80), stop)
        if lead < stop and data[lead] >= 0xC0 and lead + (2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)) > stop:
            stop = lead
    return data[start:stop]


def cut(data: bytes, first: np.ndarray, last: np.ndarray, length: int, whole: bool, whole_characters: bool = False) -> tuple:
    """The result's columns for a text whose windows from ``first`` up to ``last`` repeat."""
    if whole:
        return len(data), len(data), int(len(data) > 0), hashlib.sha256(b"").hexdigest(), b""
    if not len(first):
        return len(data), 0, 0, hashlib.sha256(data).hexdigest(), data
    order = np.argsort(first, kind="stable")
    start, stop = first[order], np.maximum.accumulate(last[order] + length - 1)
    opens = np.concatenate([[True], start[1:] > stop[:-1]])
    starts, stops = start[opens].tolist(), stop[np.append(np.flatnonzero(opens)[1:] - 1, len(stop) - 1)].tolist()
    borders = zip([0, *stops], [*starts, len(data)], strict=True)
    kept = b"".join(inner(data, a, b) if whole_characters else data[a:b] for a, b in borders)
    return len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept


def remove_repeats(
    docs: DataFrame, text: str = "text", length: int = LENGTH, kmer: int = KMER, period: int = PERIOD, cover: tuple[int, ...] = COVER,
    whole_characters: bool = False,
) -> DataFrame:
    """``row`` (the document), ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (the remaining bytes;
    with ``whole_characters`` without the parts of characters that cuts leave, which count as removed)."""
    if not (0 < period < length and 0 < kmer <= length):
        raise ValueError("the period must be below the length and the minimizers' strings no longer than it")
    spans = repeated_spans(docs, text, length, kmer, period, cover)
    rows = docs.select(whole_row(docs).alias("row"), text_key(docs[text]).alias("key"))
    content = F.col("row").getField(text).cast("binary").alias("text")  # taken from the row after the join, which moves each text once
    joined = rows.join(spans, "key", "left").select("row", content, "whole", "spans.a", "spans.b", "starts")
    schema = T.StructType([joined.schema["row"], *T.StructType.fromDDL(_RESULT).fields])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    none = np.zeros(0, dtype=np.int64)

    def numbers(value: pa.Scalar) -> np.ndarray:
        return value.values.to_numpy(zero_copy_only=False).astype(np.int64) if value.is_valid else none

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, found = batch.slice(at, 64), []
                for i in range(part.num_rows):
                    a, b, starts = (numbers(part.column(c)[i]) for c in (3, 4, 5))
                    first, last = np.concatenate([a, starts]), np.concatenate([b, starts + 1])
                    found.append(cut(part.column(1)[i].as_py() or b"", first, last, length, bool(part.column(2)[i].as_py()), whole_characters))
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, schema)
