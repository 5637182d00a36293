"""Benchmark decontamination: a broadcast set of normalised benchmark windows, scanned over whole texts.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. A window is
``width`` consecutive words of a benchmark item, or the whole item where it has fewer. A document
word is *hit* if it lies inside any occurrence of a window.

The window set is measured before it is broadcast. Where it is larger than ``broadcast_bytes`` it is
split by hash into blocks below that size, and the documents are scanned once per block, written
between the scans: exact at every size, and no executor holds more than one block.

Defined results: a NULL or empty text has no words and is never contaminated; a NULL or wordless item
has no windows; items that share an ``item_id`` count as one; an item without an id marks words but is
not listed; repeated documents are judged one by one; an empty benchmark hits nothing.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import over_texts, whole_row

WIDTH = 13
#: The bytes that separate words.
_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_UPPER = range(0x41, 0x5B)
_WORD_PATTERN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_FOUND = "n_words bigint, hits array<int>, items array<string>"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normalising_table() -> bytes:
    """Maps a byte of UTF-8 text to itself, its lower case, or a space between words."""
    table = bytearray(range(256))
    for code in _SEPARATORS:
        table[code] = 0x20
    for code in _UPPER:
        table[code] = code + 32
    return bytes(table)


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, width: int = WIDTH) -> DataFrame:
    """Distinct windows: ``words`` (joined by one space), ``n`` and the ``items`` that hold them."""
    lower = F.translate(F.col(text), "".join(map(chr, _UPPER)), "".join(chr(c + 32) for c in _UPPER))
    words = F.regexp_extract_all(lower, F.lit(f"({_WORD_PATTERN})"), F.lit(1))
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return (
        items.select("item", "w", F.explode(starts).alias("at"))
        .select("item", F.expr(f"slice(w, at, {width})").alias("part"))
        .groupBy(F.array_join("part", " ").alias("words"))
        .agg(F.max(F.size("part")).alias("n"), F.collect_set("item").alias("items"))
    )


class WindowSet:
    """The windows of one block, ready to look up: word numbers, and per length sorted hashes over them."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], list[str]]] = {}
        for words, items in rows:
            numbers = tuple(vocabulary.setdefault(w, len(vocabulary)) for w in words.encode().split(b" "))
            by_length.setdefault(len(numbers), {})[numbers] = items
        self.vocabulary, self.by_length = vocabulary, by_length
        self.hashes = {
            n: np.sort(rolling(np.array(list(windows), dtype=np.int64).reshape(-1), n)[::n])
            for n, windows in by_length.items()
        }


def rolling(numbers: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` consecutive numbers."""
    values = (numbers + 1).astype(np.uint64) * _MULTIPLIER
    values ^= values >> np.uint64(29)
    total = np.zeros(max(len(values) - n + 1, 0), dtype=np.uint64)
    for k in range(n):
        total = total * np.uint64(0x100000001B3) + values[k : k + len(total)]
    return total


def scan(windows: WindowSet, words: list[bytes]) -> tuple[list[int], set[str]]:
    """Word positions inside an occurrence of a window, in order, and the items of those windows."""
    numbers = np.fromiter(map(windows.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
    unknown = np.concatenate([[0], np.cumsum(numbers < 0)])
    hit, items = np.zeros(len(words) + 1, dtype=np.int64), set()
    for n, known in windows.by_length.items():
        if len(words) < n:
            continue
        starts = np.flatnonzero(unknown[n:] == unknown[:-n])
        if not len(starts):
            continue
        codes = rolling(numbers, n)[starts]
        places = np.minimum(np.searchsorted(windows.hashes[n], codes), len(windows.hashes[n]) - 1)
        for at in starts[windows.hashes[n][places] == codes].tolist():
            found = known.get(tuple(numbers[at : at + n].tolist()))
            if found is not None:
                hit[at] += 1
                hit[at + n] -= 1
                items.update(found)
    return np.flatnonzero(np.cumsum(hit[:-1]) > 0).tolist(), items


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WIDTH, broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """``row`` (the document), ``n_words``, ``hits`` (positions of hit words), ``items`` and ``contaminated``.

    A document is contaminated if a twentieth of its words or more are hit, and at least one.
    """
    spark = docs.sparkSession
    windows = stage(benchmark_windows(benchmark, item_id, item_text, width), "windows")
    size = F.octet_length("words") + 24 * F.col("n") + F.aggregate("items", F.lit(64), lambda a, x: a + F.length(x) + 64)
    total = windows.agg(F.sum(size)).first()[0] or 0
    blocks = total // broadcast_bytes + 1
    scanned = docs.select(whole_row(docs).alias("doc"))
    scanned = scanned.select("doc", F.lit(None).cast("array<int>").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    for block in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block).select("words", "items").toLocalIterator()
        shared = spark.sparkContext.broadcast([(r["words"], list(r["items"])) for r in rows])
        scanned = _scan_block(scanned, text, shared)
        if block + 1 < blocks:
            scanned = stage(scanned, "scanned")
            shared.unpersist()
    hit = F.size("hits")
    return scanned.select(
        F.col("doc").alias("row"), "n_words", "hits", F.array_sort("items").alias("items"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def _scan_block(scanned: DataFrame, text: str, shared) -> DataFrame:
    def make():
        windows, table = WindowSet(shared.value), normalising_table()

        def work(texts: list) -> list:
            counts, hits, items = [], [], []
            for value in texts:
                words = (value or b"").translate(table).split()
                positions, names = scan(windows, words) if words else ([], set())
                counts.append(len(words))
                hits.append(positions)
                items.append(list(names))
            return [counts, hits, items]

        return work

    names = [c for c in ("doc", "hits", "items") if c in scanned.columns]
    found = over_texts(scanned.select(*names), F.col("doc").getField(text), make, _FOUND)
    old = F.col("row")
    return found.select(
        old.getField("doc").alias("doc"), "n_words",
        F.array_sort(F.array_union(F.coalesce(old.getField("hits"), F.array().cast("array<int>")), "hits")).alias("hits"),
        F.array_union(F.coalesce(old.getField("items"), F.array().cast("array<string>")), "items").alias("items"),
    )


def clean(found: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return found.where(~F.col("contaminated")).select("row.*")


def without_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """All documents, ``kept_text`` added: their texts without the hit words and what separates these from each other."""

    def make():
        import re

        pattern, lower = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), bytes.maketrans(bytes(_UPPER), bytes(c + 32 for c in _UPPER))

        def cut(value: bytes, hits: list[int]) -> str:
            spans = [m.span() for m in pattern.finditer(value.translate(lower))]
            out, at, i = [], 0, 0
            while i < len(hits):
                j = i
                while j + 1 < len(hits) and hits[j + 1] == hits[j] + 1:
                    j += 1
                out.append(value[at : spans[hits[i]][0]])
                at, i = spans[hits[j]][1], j + 1
            return b"".join([*out, value[at:]]).decode("utf-8", "replace")

        return lambda texts, hits: [[v and cut(v, h) if h else v and v.decode("utf-8", "replace") for v, h in zip(texts, hits, strict=True)]]

    return _with_hits(found, text, make)


def _with_hits(found: DataFrame, text: str, make) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql import types as T

    packed = found.select("row", F.col("row").getField(text).cast("binary").alias("text"), "hits")
    schema = T.StructType([packed.schema["row"], T.StructField("kept_text", T.StringType())])

    def run(batches):
        work = make()
        for batch in batches:
            values = work(batch.column(1).to_pylist(), batch.column(2).to_pylist())[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.string())], names=["row", "kept_text"])

    return packed.mapInArrow(run, schema)
