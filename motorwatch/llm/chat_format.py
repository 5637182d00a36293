"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

An example is the conversation up to and including one assistant turn; only that reply is trainable. Writing out each
prefix would repeat a conversation of n turns n/2 times, without bound where one conversation holds a third of all rows.
So the formatted conversation is stored once, one row per turn with its place in the formatted stream, and an example is a row
of :func:`examples`: its context is the stream up to ``context_stop``, its loss mask the span ``loss_start`` to ``loss_stop``.
:func:`render` writes the examples out as strings where conversations are known to be short.

Template: other turns are ``[INST] role\\ntext [/INST]``, an assistant's `` text </s>``. A control string inside a text gets one
more backslash in front than it had, which the reader takes away again; as a marker always follows a blank, no text can
run into it.

Defined results: NULL texts and roles are empty; a NULL conversation is one of its own; equal turn numbers are
ordered by role, then text, NULL turns come first; repeated rows are repeated turns; a conversation without assistant
turns is stored and has no examples; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches

ASSISTANT = "assistant"
#: The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_PATTERN = "|".join(re.escape(c) for c in CONTROL)
_JAVA_PATTERN = "</?s>|\\[/?INST\\]"
_OPEN, _CLOSE, _END = "[INST] ", " [/INST]", " </s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"(\\\\*)({_JAVA_PATTERN})", "\\\\$1$2")


def unescape(text: str) -> str:
    return re.sub(rf"\\(\\*)({_PATTERN})", r"\1\2", text)


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per turn: ``conv_id``, ``at`` (0, 1, ...), ``piece``, ``start``, ``stop`` (code points in the formatted stream), ``trainable``."""
    given = turns.select(
        turns[conv].alias("conv_id"), turns[turn].alias("turn"),
        F.coalesce(turns[role], F.lit("")).alias("role"), F.coalesce(turns[text], F.lit("")).alias("text"),
    )
    name = escape(F.replace(F.replace("role", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))
    spoken = F.col("role") == ASSISTANT
    piece = F.when(spoken, F.concat(F.lit(" "), escape(F.col("text")), F.lit(_END))).otherwise(
        F.concat(F.lit(_OPEN), name, F.lit("\n"), escape(F.col("text")), F.lit(_CLOSE))
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    length = F.length("piece").cast("long")
    return (
        given.withColumn("piece", piece).withColumn("trainable", spoken)
        .withColumn("at", F.row_number().over(order) - 1)
        .withColumn("stop", F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .select("conv_id", F.col("at").cast("long").alias("at"), "piece", (F.col("stop") - length).alias("start"), "stop", "trainable")
    )


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: where its context ends and its loss mask lies in the formatted stream."""
    return formatted.where("trainable").select(
        "conv_id", F.col("at").alias("target_turn"), F.col("start").alias("context_stop"),
        (F.col("start") + 1).alias("loss_start"), (F.col("stop") - len(_END)).alias("loss_stop"), "stop",
    )


def render(formatted: DataFrame) -> DataFrame:
    """The examples as strings: ``context`` and ``target``. Quadratic in the turns of a conversation by nature."""
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    pieces = formatted.withColumn("context", F.array_join(F.collect_list("piece").over(before), ""))
    return pieces.where("trainable").select("conv_id", F.col("at").alias("target_turn"), "context", F.col("piece").alias("target"))


def parse_piece(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if piece.startswith(_OPEN):
        name, _, body = piece[len(_OPEN) : -len(_CLOSE)].partition("\n")
        return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(name)), unescape(body)
    return ASSISTANT, unescape(piece[1 : -len(_END)])


def digests(formatted: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Per conversation, read back from the formatted turns: counts and SHA-256 of all turns and of the text under the loss masks.

    The masks are those of ``targets``, rows of :func:`examples` (made here if not given); each follows its turn. A digest takes its turns one after another, so a conversation's rows meet in one task, sorted; they stream
    through it and none but the current batch is held.
    """
    small_batches(formatted.sparkSession)
    masks = (examples(formatted) if targets is None else targets).select(
        "conv_id", F.col("target_turn").alias("at"), F.lit(None).cast("string").alias("piece"),
        F.col("loss_start").alias("start"), F.col("loss_stop").alias("stop"), F.lit(True).alias("mask"),
    )
    rows = formatted.select("conv_id", "at", "piece", "start", "stop", F.lit(False).alias("mask")).unionByName(masks)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "at", "mask")
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        current, state, turn = (), None, None

        def result():
            n, turns, chars, loss, stop = state
            return current[0], n, turns.hexdigest(), chars, loss.hexdigest(), stop

        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)]
            for conv, piece, start, stop, mask in zip(*columns, strict=True):
                if current != (conv,):
                    if state:
                        out.append(result())
                    current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if mask:
                    said, begin = turn
                    under = unescape(said[start - begin : stop - begin])
                    state[2] += len(under)
                    state[3].update(under.encode())
                    continue
                turn = piece, start
                role, text = parse_piece(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] = stop
            yield record(out)
        if state:
            yield record([result()])

    conv_type = to_arrow_type(formatted.schema["conv_id"].dataType)

    def record(out):
        kinds = (conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    return rows.mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
