"""Token counts without tokens: Aho-Corasick finds the vocabulary's pieces, dynamic programming carries score and count.

The tokenizer is the unigram model as public libraries run it: spaces become ``▁``, one is put in front where the text
has none, and each ``▁`` opens a new word. Within a word the best path is the one with the highest sum of piece scores,
summed from the left in double precision. Exact tie rule: a path must be strictly better to replace another, and starts
are tried from the left, so of equal paths that with the longest last piece wins. A character without a piece of its own
costs ten less than the lowest score; neighbouring such characters fuse and, with ``byte_fallback``, count one per byte.

The vocabulary is the list of pieces and scores of a model file whose path is a parameter; it is read on the driver and is
a broadcast of at most ``max_pieces`` pieces (more is an error). Words repeat, so each task remembers the counts of short words up to a bound;
a forgotten or long word is counted anew. Nothing is shuffled. One word costs at most its length times the longest piece.

Defined results: NULL and empty texts have no tokens; equal texts have equal counts; a text without spaces is one word of any length.
"""

from __future__ import annotations

import ahocorasick
from pyspark.sql import DataFrame

from .common import over_texts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Fixed value of the tokenizer: how much lower than the lowest score an unknown character is.
UNKNOWN_PENALTY = 10.0
_MEMO, _MEMO_CHARS = 1 << 17, 64


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) by id, and the id of the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class Counter:
    """Counts the pieces of words."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int, byte_fallback: bool = True):
        self.known = {p for p, _ in pieces}
        self.bytes_known = byte_fallback and all(f"<0x{b:02X}>" in self.known for b in range(256))
        self.unknown_score = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        if len(self.matches):
            self.matches.make_automaton()
        self.memo: dict[str, int] = {}

    def _run(self, word: str, start: int, end: int) -> int:
        """Tokens of a run of unknown characters."""
        run = word[start:end]
        return 1 if run in self.known or not self.bytes_known else len(run.encode("utf-8", "surrogatepass"))

    def word(self, word: str) -> int:
        n, unknown = len(word), self.unknown_score
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)  # pieces of the best path, without an open run of unknown characters
        opened = [-1] * (n + 1)  # where that run starts
        at = 0
        single = False
        chosen, score = -1, 0.0

        def close(end: int) -> None:
            nonlocal chosen, score, single
            if not single:
                other = unknown + best[end - 1]
                if chosen < 0 or other > score:
                    best[end], count[end] = other, count[end - 1]
                    opened[end] = opened[end - 1] if opened[end - 1] >= 0 else end - 1
                    chosen, single = -1, False
                    return
            best[end] = score
            count[end] = count[chosen] + 1 + (self._run(word, opened[chosen], chosen) if opened[chosen] >= 0 else 0)
            chosen, single = -1, False

        if len(self.matches):
            for last, (length, piece_score) in self.matches.iter(word):
                while at < last:
                    at += 1
                    close(at)
                candidate = best[last + 1 - length] + piece_score
                if chosen < 0 or candidate > score:
                    chosen, score = last + 1 - length, candidate
                single = single or length == 1
        while at < n:
            at += 1
            close(at)
        return count[n] + (self._run(word, opened[n], n) if opened[n] >= 0 else 0)

    def text(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        total, memo = 0, self.memo
        for part in text.split(SPACE)[text.startswith(SPACE) :]:
            n = memo.get(part)
            if n is None:
                n = self.word(SPACE + part)
                if len(part) <= _MEMO_CHARS:
                    if len(memo) >= _MEMO:
                        memo.clear()
                    memo[part] = n
            total += n
        return total


def count_tokens(
    docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, byte_fallback: bool = True, max_pieces: int = 1 << 20,
) -> DataFrame:
    """``row`` (the document), ``n_chars`` and ``n_tokens`` of every whole text."""
    pieces, unknown = read_vocabulary(vocabulary)
    if len(pieces) > max_pieces:
        raise ValueError(f"a vocabulary of {len(pieces)} pieces is over the bound of {max_pieces}")
    shared = docs.sparkSession.sparkContext.broadcast((pieces, unknown))

    def make():
        counter = Counter(*shared.value, byte_fallback)

        def work(texts: list) -> list:
            plain = [(t or b"").decode("utf-8", "replace") for t in texts]
            return [[len(t) for t in plain], [counter.text(t) for t in plain]]

        return work

    return over_texts(docs, docs[text], make, "n_chars bigint, n_tokens bigint")
