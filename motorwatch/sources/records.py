"""Delimited records whose quoted fields may hold line breaks, from files that stay splittable.

Whether a line starts inside quotes depends on all lines before it. A line is a function from (inside or outside before) to
(inside or outside behind), and so is a run of lines. The first pass composes the lines of each split to one such function, the splits of a
file are composed in order of their start, which gives the state each split begins in, and the second pass joins
lines to records from the right state on. Records that lie in one split leave the task whole; of others the parts are stitched, at most two
for a split that holds whole records. Lines without a quote pass by as slices of their Arrow batch.

A quote opens a field only at its start, as the common readers have it; elsewhere in a field it is a character (``15" wheel``).
A doubled quote inside a quoted field is a quote, and what follows a closing quote up to the separator belongs to the field.
Records end in LF or CRLF; breaks inside quotes stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage

#: A record longer than this is taken for a quote that was never closed.
LONGEST_RECORD = 64 << 20
#: Bytes of an unfinished record that a task holds before it hands on a part.
HELD = 1 << 20
#: Splits that start inside quotes are broadcast up to this number; beyond it lines and states are joined by a shuffle.
MOST_OPEN = 100_000
#: Encodings whose quotes and line breaks are the bytes of ASCII, and which Spark decodes whatever the bytes are.
ASCII_BASED = ("UTF-8", "ISO-8859-1")
COMPLETE, OPENS, GOES_ON, CLOSES = 0, 1, 2, 3


def ends_inside(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether the line ends inside a quoted field, if it starts inside or outside of one."""
    opener = sep + b'"'
    if inside:
        at = 0
    elif line[:1] == b'"':
        at = 1
    else:
        at = line.find(opener)
        if at < 0:
            return False
        at += len(opener)
    while True:
        quote = line.find(b'"', at)
        if quote < 0:
            return True
        if line[quote + 1 : quote + 2] == b'"':
            at = quote + 2
            continue
        at = line.find(opener, quote + 1)
        if at < 0:
            return False
        at += len(opener)


def join_lines(lines: Iterator[bytes], sep: bytes) -> Iterator[bytes]:
    """Records from lines that keep their line breaks, one after the other."""
    held: list[bytes] = []
    size = 0
    for line in lines:
        inside = ends_inside(line, bool(held), sep)
        if held or inside:
            held.append(line)
            size += len(line)
            if size > LONGEST_RECORD:
                raise ValueError(f"a record is longer than {LONGEST_RECORD} bytes: is a quote not closed?")
        if not inside:
            yield (b"".join(held) if held else line).removesuffix(b"\n").removesuffix(b"\r")
            held, size = [], 0
    if held:
        yield b"".join(held).removesuffix(b"\n").removesuffix(b"\r")


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "path"), ("file_block_start", "block"))]
    return spark.read.option("lineSep", "\n").text(paths).select(*meta, F.col("value").cast("binary").alias("line"))


def _runs(path: pa.Array, block: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that come from one split."""
    n = len(block)
    if not n:
        return
    codes, starts = pc.dictionary_encode(path).indices.to_numpy(), block.to_numpy()
    changes = np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1
    yield from zip([0, *changes.tolist()], [*changes.tolist(), n], strict=True)


def _with_quotes(lines: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.greater_equal(pc.find_substring(lines, b'"'), 0).to_numpy(zero_copy_only=False))


def split_states(spark: SparkSession, paths: str | list[str], sep: str, heads: bool = False) -> DataFrame:
    """A written table: per split ``path``, ``block``, ``inside`` (the state it begins in), ``breaks`` (whether a line that starts a record does not
    end it) and with ``heads`` the first record of each file, ``head``.

    Only lines with quotes leave the JVM, and with ``heads`` those of a file's first split.
    """
    needed = F.contains(F.col("line").cast("string"), F.lit('"'))  # compares bytes, whatever the encoding
    lines = _lines(spark, paths)
    taken = lines.select("path", "block", F.when(needed | (F.col("block") == 0) if heads else needed, F.col("line")).alias("line"))
    between = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, head = None, [False, True], None
        breaks = False

        def result():
            joined = next(join_lines(iter(head), between), b"") if head else None
            columns = [[current[0]], [current[1]], [state[0]], [state[1]], [breaks], [joined]]
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary())
            names = ["path", "block", "from_outside", "from_inside", "breaks", "head"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for start, stop in _runs(batch.column(0), batch.column(1)):
                place = batch.column(0)[start].as_py(), batch.column(1)[start].as_py()
                if place != current:
                    if current:
                        yield result()
                    current, state, breaks, head = place, [False, True], False, [] if heads and place[1] == 0 else None
                    open_head = head is not None
                part = batch.column(2).slice(start, stop - start)
                at = 0
                while head is not None and open_head and at < len(part):
                    head.append((part[at].as_py() or b"") + b"\n")
                    open_head = ends_inside(head[-1], len(head) > 1, between)
                    at += 1
                quoted = part.drop_null()
                for i in _with_quotes(quoted).tolist():
                    line = quoted[i].as_py()
                    outside = ends_inside(line, False, between)
                    state = [ends_inside(line, True, between) if s else outside for s in state]
                    breaks = breaks or outside
        if current:
            yield result()

    found = taken.mapInArrow(run, "path string, block bigint, from_outside boolean, from_inside boolean, breaks boolean, head binary")
    # States compose from the last split that forgets its own, by the number of splits behind it that turn them over.
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    fixed = F.col("from_outside") == F.col("from_inside")
    counted = found.withColumn("turned", F.sum(turns).over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(fixed, F.struct(F.col("from_outside").alias("state"), F.col("turned").alias("at"))), ignorenulls=True).over(before)
    odd = ((F.coalesce(F.lag("turned").over(Window.partitionBy("path").orderBy("block")), F.lit(0)) - F.coalesce(F.col("last.at"), F.lit(0))) % 2) == 1
    inside = F.coalesce(F.col("last.state"), F.lit(False)) != odd
    return stage(counted.withColumn("last", last).select("path", "block", inside.alias("inside"), "breaks", "head"), "splits")


def has_breaks(states: DataFrame) -> bool:
    """Whether any record holds a line break: if no line leaves a record open, no split begins inside one."""
    return bool(states.where("breaks").head(1))


def read_records(
    spark: SparkSession, paths: str | list[str], sep: str, encoding: str, states: DataFrame | None = None, most_open: int = MOST_OPEN
) -> DataFrame:
    """``path``, ``first`` (the first record of its file) and ``record`` (text without the line break at its end)."""
    if encoding.upper() not in ASCII_BASED:
        raise ValueError(f"quotes cannot be looked for in the bytes of {encoding}")
    states = states if states is not None else split_states(spark, paths, sep)
    opened = states.where("inside").select("path", "block", "inside")
    lines = _lines(spark, paths)
    if opened.count() <= most_open:
        given = lines.join(F.broadcast(opened), ["path", "block"], "left")  # keeps the order of lines
    else:
        placed = lines.withColumn("n", F.monotonically_increasing_id()).join(opened, ["path", "block"], "left")
        given = placed.repartition("path", "block").sortWithinPartitions("path", "block", "n")
    given = given.select("path", "block", F.coalesce("inside", F.lit(False)).alias("inside"), "line")
    between = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size, opening, n = None, None, 0, False, 0

        def rows(place, first, lines, part):
            k = len(lines)
            arrays = [pa.array([place[0]] * k, pa.string()), pa.array([place[1]] * k, pa.int64()), pa.array(first, pa.bool_())]
            arrays += [pa.array([n] * k, pa.int64()), pa.array([part] * k, pa.int8()), lines]
            return pa.RecordBatch.from_arrays(arrays, names=["path", "block", "first", "n", "part", "line"])

        def piece(part):
            """What is held, as a part of a record."""
            nonlocal held, size, opening, n
            n += 1
            out = rows(current, [opening and current[1] == 0 and n == 1 and untouched], pa.array([b"\n".join(held)], pa.binary()), part)
            held, size, opening = [], 0, False
            return out

        untouched = True
        for batch in batches:
            for start, stop in _runs(batch.column(0), batch.column(1)):
                place = batch.column(0)[start].as_py(), batch.column(1)[start].as_py()
                if place != current:
                    if held:
                        yield piece(OPENS if opening else GOES_ON)
                    current, n, untouched = place, 0, True
                    held, size, opening = ([] if batch.column(2)[start].as_py() else None), 0, False
                part = batch.column(3).slice(start, stop - start)
                at = 0
                whole: list[pa.Array] = []
                for i in [*_with_quotes(part).tolist(), len(part)]:
                    if held is None:
                        if i > at:
                            whole.append(part.slice(at, i - at))
                    else:
                        held += part.slice(at, i - at).to_pylist()
                    if i < len(part):
                        line = part[i].as_py()
                        inside = ends_inside(line, held is not None, between)
                        if held is None and not inside:
                            whole.append(part.slice(i, 1))
                        elif held is None:
                            if whole:
                                joined = pa.concat_arrays(whole)
                                yield rows(current, [current[1] == 0 and untouched, *[False] * (len(joined) - 1)], joined, COMPLETE)
                                whole, untouched = [], False
                            held, opening = [line], True
                        else:
                            held.append(line)
                            if not inside:
                                yield piece(COMPLETE if opening else CLOSES)
                                held, untouched = None, False
                    at = i + 1
                if whole:
                    joined = pa.concat_arrays(whole)
                    yield rows(current, [current[1] == 0 and untouched, *[False] * (len(joined) - 1)], joined, COMPLETE)
                    untouched = False
                if held and sum(map(len, held)) > HELD:
                    yield piece(OPENS if opening else GOES_ON)
        if held:
            yield piece(OPENS if opening else GOES_ON)

    parts = given.mapInArrow(run, "path string, block bigint, first boolean, n bigint, part tinyint, line binary")
    text = _trimmed(decoded(F.col("line"), encoding))
    complete = parts.where(F.col("part") == COMPLETE).select("path", "first", text.alias("record"))
    return complete.unionByName(_stitched(parts.where(F.col("part") != COMPLETE), encoding))


def decoded(line: Column, encoding: str) -> Column:
    """Text of bytes; of UTF-8 broken characters become U+FFFD."""
    return F.make_valid_utf8(line.cast("string")) if encoding.upper() == "UTF-8" else F.decode(line, encoding)


def _trimmed(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit("\r")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def _stitched(parts: DataFrame, encoding: str) -> DataFrame:
    """Records that run over the end of a split."""
    order = Window.partitionBy("path").orderBy("block", "n")
    numbered = parts.withColumn("record_no", F.sum((F.col("part") == OPENS).cast("int")).over(order))
    sized = numbered.withColumn("size", F.sum(F.octet_length("line")).over(Window.partitionBy("path", "record_no")))
    message = F.concat(F.lit("a record is too long, is a quote not closed? In "), F.col("path"))
    checked = F.when(F.col("size") > LONGEST_RECORD, F.raise_error(message).cast("binary")).otherwise(F.col("line"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "n", decoded(checked, encoding).alias("said"))))
    joined = sized.groupBy("path", "record_no").agg(pieces.alias("pieces"), F.max("first").alias("first"))
    return joined.select("path", "first", _trimmed(F.array_join("pieces.said", "\n")).alias("record"))
