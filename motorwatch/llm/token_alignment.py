"""Alignment of two tokenizers by merge-path partitioning of their token ends.

Each text is cut by both tokenizers. Their token ends, as byte offsets, are two ascending lists; merging them finds the
offsets where both end. The merge path of the two lists is divided by diagonals: on diagonal ``d`` a binary search finds how many
of the first ``d`` merged ends are A's, so the pieces between two diagonals hold equally many ends and are merged without
knowing of each other. A piece is a row of a written table, so a very long text is many rows. Ends that
fall together stay in one piece. Each piece yields the links it holds (token pairs that end together) and the groups that lie
wholly inside it, and what is open at its two borders; :func:`documents` stitches open borders of neighbouring pieces into groups.

Counts of linked id pairs over the whole corpus are summed in tasks before they are shuffled. Of two tokens that end together
one is a suffix of the other, so their number is bounded by the two vocabularies alone (:meth:`Vocabularies.most_pairs`, some
hundred thousand); only because of this bound, which is checked, the counts are broadcast. Nothing is keyed by a token pair
but these counts, so a frequent pair makes no hot task.

A byte-level vocabulary whose merges are in the order of their tokens' ids, as its file says, is encoded by ranks, which is
several times faster than its own library and gives the same tokens; any other is encoded by that library. Texts are encoded whole, a few at a time.

Defined results: NULL and empty texts, and those whose joined token bytes are not the text with one space in front, have no tokens,
all counts 0 and an empty digest; repeated documents are counted each; ids may repeat or be NULL; no documents give no rows. ``row`` carries
the columns other than the text, so no name can clash.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .common import small_batches

VOCABULARY_A, VOCABULARY_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Ends in a piece, and the most linked pairs that may be broadcast.
PIECE_ENDS = 1 << 16
MOST_PAIRS = 1 << 22
SPACE = "▁"
#: Fixed value: how byte-level vocabularies split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 is itself, the others follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + n): b for n, b in enumerate(others)}


class Vocabularies:
    """Both tokenizer files, read on the driver; workers build the tokenizers from these bytes."""

    def __init__(self, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B):
        with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
            self.json, self.model = a.read(), b.read()

    def tokenizers(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_str(self.json)
        a.encode_special_tokens = True
        return a, sentencepiece.SentencePieceProcessor(model_proto=self.model)

    def token_bytes(self) -> tuple[list[bytes], list[bytes]]:
        """The bytes of every token of A and B, by id."""
        a, b = self.tokenizers()
        letters, entries = byte_letters(), a.get_vocab()
        of_a = [b""] * (max(entries.values(), default=-1) + 1)
        for entry, i in entries.items():
            of_a[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        of_b = []
        for i in range(b.get_piece_size()):
            piece = b.id_to_piece(i)
            of_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace(SPACE, " ").encode())
        return of_a, of_b

    def most_pairs(self) -> int:
        """How many id pairs can end together: pairs of which one token's bytes are a suffix of the other's."""
        of_a, of_b = self.token_bytes()
        ids: list[dict[bytes, int]] = [{}, {}]
        for known, tokens in zip(ids, (of_a, of_b), strict=True):
            for t in tokens:
                known[t] = known.get(t, 0) + 1
        longer_a = sum(ids[1].get(t[k:], 0) for t in of_a for k in range(len(t)))
        return longer_a + sum(ids[0].get(t[k:], 0) for t in of_b for k in range(1, len(t)))


def by_ranks(vocabularies: Vocabularies, of_a: list[bytes]):
    """A's encoder by ranks; None where its file asks for anything but plain byte-level merges in the order of ids."""
    told = json.loads(vocabularies.json)
    model, before = told["model"], told["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not model.get("ignore_merges") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    plain = plain and told["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    ids = [model["vocab"].get("".join(m), -1) for m in merges]
    if not plain or any(x >= y for x, y in zip(ids, ids[1:], strict=False)) or len(ids) + 256 != len(model["vocab"].keys() - {t["content"] for t in told["added_tokens"]}):
        return None
    import tiktoken

    special = {t["id"] for t in told["added_tokens"]}
    ranks = {t: i for i, t in enumerate(of_a) if i not in special}
    return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Encodes texts by both tokenizers; a text with other joined bytes than its own has no tokens."""

    def __init__(self, vocabularies: Vocabularies):
        self.a, self.b = vocabularies.tokenizers()
        self.bytes_a, self.bytes_b = vocabularies.token_bytes()
        self.ranks = by_ranks(vocabularies, self.bytes_a)

    def ids_a(self, text: str) -> list[int]:
        return self.ranks.encode_ordinary(text) if self.ranks else self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids_a, ids_b, whole = [], [], b" " + text.encode()
        if text:
            ids_a, ids_b = self.ids_a(" " + text), self.b.encode([text], num_threads=1)[0]
            if any(b"".join(map(known.__getitem__, ids)) != whole for known, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))):
                ids_a, ids_b = [], []
        return np.array(ids_a, np.int32), np.array(ids_b, np.int32)


def diagonals(ends_a: np.ndarray, ends_b: np.ndarray, size: int = PIECE_ENDS) -> list[tuple[int, int]]:
    """Places (ends of A, ends of B) where the merge path crosses the diagonals ``size``, ``2 * size``, ..., and its two ends.

    Of equal ends A's comes first; where a diagonal would part two equal ends, B's joins the earlier piece.
    """
    m, n = len(ends_a), len(ends_b)
    found = [(0, 0)]
    for d in range(size, m + n, size):
        low, high = max(0, d - n), min(d, m)
        while low < high:
            i = (low + high) // 2
            if ends_a[i] <= ends_b[d - 1 - i]:
                low = i + 1
            else:
                high = i
        i, j = low, d - low
        if i and j < n and ends_a[i - 1] == ends_b[j]:
            j += 1
        if (i, j) != found[-1]:
            found.append((i, j))
    if found[-1] != (m, n):
        found.append((m, n))
    return found if len(found) > 1 else [(0, 0), (0, 0)]


def merge(a: np.ndarray, b: np.ndarray, start_a: int, start_b: int, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the tokens that end together."""
    ends_a, ends_b = start_a + np.cumsum(size_a[a]), start_b + np.cumsum(size_b[b])
    if not len(ends_a) or not len(ends_b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(ends_b, ends_a)
    hit = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a
    return np.flatnonzero(hit), at[hit]


class Writer:
    """Groups as text: ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, n_a: int, n_b: int):
        def table(n, mark):
            return np.array([f"{i}{mark}" for i in range(n)] or [""], object)

        self.a, self.last_a, self.b, self.last_b = table(n_a, ","), table(n_a, "|"), table(n_b, ","), table(n_b, ";")

    def groups(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> str:
        """The groups that end at these places, each followed by ``;``; the first starts with the first tokens."""
        if not len(in_a):
            return ""
        a, b = a[: in_a[-1] + 1], b[: in_b[-1] + 1]
        at_a = np.arange(len(a)) + np.repeat(np.concatenate(([0], in_b[:-1] + 1)), np.diff(in_a, prepend=-1))
        at_b = np.arange(len(b)) + np.repeat(in_a + 1, np.diff(in_b, prepend=-1))
        out = np.empty(len(a) + len(b), object)
        out[at_a], out[at_b] = self.a[a], self.b[b]
        out[at_a[in_a]], out[at_b[in_b]] = self.last_a[a[in_a]], self.last_b[b[in_b]]
        return "".join(out.tolist())


_PIECES = "at bigint, piece int, pieces int, start_a bigint, start_b bigint, a array<int>, b array<int>"
_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    values = np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _arrays(lists: pa.Array) -> list[np.ndarray]:
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [values[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)]


def token_pieces(docs: DataFrame, vocabularies: Vocabularies, text: str = "text", piece_ends: int = PIECE_ENDS) -> DataFrame:
    """A written table: per piece of a document ``row``, ``at`` (the document), ``piece`` of ``pieces``, where its tokens start, and its ids."""
    small_batches(docs.sparkSession)
    others = [docs[f"`{c}`"].alias(c) for c in docs.columns if c != text] or [F.lit(None).cast("string").alias("none")]
    packed = docs.select(F.struct(*others).alias("row"), F.monotonically_increasing_id().alias("at"), docs[text].cast("string").alias("t"))
    schema = T.StructType([packed.schema["row"], *T.StructType.fromDDL(_PIECES).fields])
    shared = docs.sparkSession.sparkContext.broadcast(vocabularies)

    def run(batches):
        encoder = Encoder(shared.value)
        size_a, size_b = (np.array([len(t) for t in known], np.int64) for known in (encoder.bytes_a, encoder.bytes_b))

        def steps(texts):
            """Ranges of rows of about a million characters."""
            start, size = 0, 0
            for i, t in enumerate(texts):
                if size and size + len(t) > 1 << 20:
                    yield start, i
                    start, size = i, 0
                size += len(t)
            yield start, len(texts)

        for batch in batches:
            texts, ids = [t or "" for t in batch.column(2).to_pylist()], batch.column(1).to_pylist()
            for start, stop in steps(texts):
                rows, columns, lists = [], [[] for _ in range(5)], ([], [])
                for i in range(start, stop):
                    a, b = encoder.encode(texts[i])
                    ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
                    path = diagonals(ends_a, ends_b, piece_ends)
                    for k, ((i0, j0), (i1, j1)) in enumerate(zip(path, path[1:], strict=False)):
                        rows.append(i)
                        starts = int(ends_a[i0 - 1]) if i0 else 0, int(ends_b[j0 - 1]) if j0 else 0
                        for column, value in zip(columns, (ids[i], k, len(path) - 1, *starts), strict=True):
                            column.append(value)
                        lists[0].append(a[i0:i1])
                        lists[1].append(b[j0:j1])
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays([*arrays, *map(_lists, lists)], names=schema.names)

    return stage(packed.mapInArrow(run, schema), "token_pieces")


def _sizes(vocabularies: Vocabularies) -> tuple[np.ndarray, np.ndarray]:
    sizes = tuple(np.array([len(t) for t in known], np.int64) for known in vocabularies.token_bytes())
    if not all(s.all() for s in sizes):
        raise ValueError("a token without bytes cannot be aligned")
    return sizes


def pair_counts(pieces: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """``pair`` (A's id times 2^32 plus B's id) and ``n``, its links in the whole corpus."""
    sizes = pieces.sparkSession.sparkContext.broadcast(_sizes(vocabularies))

    def run(batches):
        keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            links = [np.empty(0, np.int64)]
            for start_a, start_b, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch.column(2)), _arrays(batch.column(3)), strict=True):
                in_a, in_b = merge(a, b, start_a, start_b, *sizes.value)
                links.append(a[in_a].astype(np.int64) << 32 | b[in_b])
            fresh, n = np.unique(np.concatenate(links), return_counts=True)
            every, place = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, place, np.concatenate([sums, n]))
            keys, sums = every, total
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])

    found = pieces.select("start_a", "start_b", "a", "b").mapInArrow(run, "pair bigint, n bigint")
    return found.groupBy("pair").agg(F.sum("n").alias("n"))


def align(pieces: DataFrame, counts: DataFrame, vocabularies: Vocabularies, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Per piece: ``row``, ``at``, ``piece``, ``pieces``, the counts, ``cut`` (whether two ends fall together), ``groups`` (those that lie wholly
    inside, and what the piece holds of its first, as text) and the ids left open behind the last, ``tail_a`` and ``tail_b``. A piece that
    closes a group holds both tokens that end it, so its text of the first group names ids of A and of B.
    """
    bound = vocabularies.most_pairs()
    if bound > most_pairs:
        raise ValueError(f"these vocabularies allow {bound} linked pairs, over the bound of {most_pairs} that may be broadcast")
    listed = counts.toArrow()  # at most ``bound`` rows
    pair, n = (listed.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    pair, n = pair[order].astype(np.int64), n[order].astype(np.int64)
    highest = np.zeros(int((pair & 0xFFFFFFFF).max()) + 1 if len(pair) else 1, np.int64)
    np.maximum.at(highest, pair & 0xFFFFFFFF, n)
    known = pair, n, n == highest[pair & 0xFFFFFFFF]
    shared = pieces.sparkSession.sparkContext.broadcast((known, _sizes(vocabularies)))
    fields = "cut boolean, groups string, tail_a array<int>, tail_b array<int>, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    taken = pieces.select("row", "at", "piece", "pieces", "start_a", "start_b", "a", "b")
    schema = T.StructType([*taken.schema.fields[:4], *T.StructType.fromDDL(fields).fields])

    def run(batches):
        (pair, n, best), sizes = shared.value
        writer = Writer(*map(len, sizes))
        for batch in batches:
            cut, text, tails, numbers = [], [], ([], []), [[] for _ in _COUNTS]
            for start_a, start_b, a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), _arrays(batch.column(6)), _arrays(batch.column(7)), strict=True):
                in_a, in_b = merge(a, b, start_a, start_b, *sizes)
                place = np.searchsorted(pair, a[in_a].astype(np.int64) << 32 | b[in_b])
                cut.append(bool(len(in_a)))
                text.append(writer.groups(a, b, in_a, in_b))
                for tail, ids, at in zip(tails, (a, b), (in_a, in_b), strict=True):
                    tail.append(ids[at[-1] + 1 :] if len(at) else ids)
                values = len(a), len(b), len(in_a), len(in_a), int(best[place].sum()), int(n[place].sum())
                for column, value in zip(numbers, values, strict=True):
                    column.append(value)
            arrays = [pa.array(cut, pa.bool_()), pa.array(text, pa.string()), *map(_lists, tails)]
            arrays += [pa.array(c, pa.int64()) for c in numbers]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], *arrays], names=schema.names)

    return taken.mapInArrow(run, schema)


def documents(pieces: DataFrame, counts: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """Per document ``row``, the counts and ``groups_sha256``.

    A document of one piece is done where it is. Pieces of longer ones meet in one task per document, sorted, as a running digest
    takes them one after another; they stream through it, and only the group that is open at a border is held.
    """
    one = align(pieces.where("pieces = 1"), counts, vocabularies)
    text = F.expr("substring(groups, 1, length(groups) - 1)")
    done = one.select("row", *_COUNTS, F.when(F.col("cut"), F.sha2(text.cast("binary"), 256)).otherwise("").alias("groups_sha256"))
    many = align(pieces.where("pieces > 1"), counts, vocabularies)
    sorted_pieces = many.repartition("at").sortWithinPartitions("at", "piece")
    names = ("row", "at", "piece", "pieces", "cut", "groups", "tail_a", "tail_b", *_COUNTS)

    def run(batches):
        open_a, open_b, digest, sums, first = [], [], None, None, True
        for batch in batches:
            rows, out = [], []
            for i, r in enumerate(batch.select(list(names[1:])).to_pylist()):
                if r["piece"] == 0:
                    open_a, open_b, digest, sums, first = [], [], hashlib.sha256(), [0] * len(_COUNTS), True
                if r["cut"]:
                    groups = r["groups"]
                    if open_a or open_b:
                        mine, rest = groups.split(";", 1)
                        ids_a, ids_b = mine.split("|")
                        groups = ",".join([*open_a, ids_a]) + "|" + ",".join([*open_b, ids_b]) + ";" + rest
                    digest.update((groups[:-1] if first else ";" + groups[:-1]).encode())
                    open_a, open_b, first = [], [], False
                open_a += map(str, r["tail_a"])
                open_b += map(str, r["tail_b"])
                sums = [s + r[c] for s, c in zip(sums, _COUNTS, strict=True)]
                if r["piece"] + 1 == r["pieces"]:
                    rows.append(i)
                    out.append((*sums, digest.hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * (len(_COUNTS) + 1)
            kinds = [pa.int64()] * len(_COUNTS) + [pa.string()]
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", *_COUNTS, "groups_sha256"])

    return done.unionByName(sorted_pieces.select(*names).mapInArrow(run, done.schema))


def align_documents(docs: DataFrame, text: str = "text", vocabularies: Vocabularies | None = None, piece_ends: int = PIECE_ENDS) -> DataFrame:
    """All steps: tokens, pieces, corpus counts, links and groups of every document."""
    vocabularies = vocabularies or Vocabularies()
    pieces = token_pieces(docs, vocabularies, text, piece_ends)
    counts = stage(pair_counts(pieces, vocabularies), "pair_counts")
    return documents(pieces, counts, vocabularies)
