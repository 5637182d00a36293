from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from motorwatch.llm import token_alignment as A

_VOCABULARIES: list[A.Vocabularies] = []


@pytest.fixture
def vocabularies():
    if not _VOCABULARIES:
        _VOCABULARIES.append(A.Vocabularies())
    return _VOCABULARIES[0]


def expected(texts: list[str | None], vocabularies: A.Vocabularies) -> list[tuple]:
    """Groups and links by comparing the sets of ends of whole texts."""
    a, b = vocabularies.tokenizers()
    letters = A.byte_letters()
    rows, counts = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            rows.append(([], [], [], ""))
            continue
        ends = [[sum(map(len, listed[: i + 1])) for i in range(len(listed))] for listed in (bytes_a, bytes_b)]
        links = [(i, j) for i, x in zip(ids_a, ends[0], strict=True) for j, y in zip(ids_b, ends[1], strict=True) if x == y]
        counts.update(links)
        groups, last = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(i) for i, x in zip(ids, e, strict=True) if last < x <= cut) for ids, e in ((ids_a, ends[0]), (ids_b, ends[1]))))
            last = cut
        rows.append((ids_a, ids_b, links, ";".join(groups)))
    highest: dict[int, int] = {}
    for (_, j), n in counts.items():
        highest[j] = max(highest.get(j, 0), n)
    return [
        (
            len(ids_a), len(ids_b), groups.count(";") + bool(groups), len(links), sum(counts[x] == highest[x[1]] for x in links),
            sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        )
        for ids_a, ids_b, links, groups in rows
    ]


@pytest.fixture
def texts():
    draw = random.Random(3)
    words = "the of Straße naïve 日本語 antidisestablishmentarianism 12345 e.g. <|endoftext|> </s> it's 😀👩‍👩‍👧 zz \t \n 　 ﬁ á <0x41>".split(" ")
    listed = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 60))) for _ in range(60)]
    return [*listed, None, "", " ", "  two  spaces ", "\n", "a", "x" * 3000, listed[0], listed[0], "e" + "́" * 50, "word " * 400, "　 ﬁ ▁ \t x", "\x00 nul"]


@pytest.mark.parametrize("piece_ends", [A.PIECE_ENDS, 64, 3, 1])
def test_documents_equal_brute_force(spark, texts, vocabularies, piece_ends):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "at int, text string, groups string").repartition(3)
    got = {r["row"]["at"]: tuple(r)[1:] for r in A.align_documents(docs, vocabularies=vocabularies, piece_ends=piece_ends).collect()}
    want = expected(texts, vocabularies)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[0] > 0 for w in want) > 60


def test_ranks_give_the_tokens_of_the_file(texts, vocabularies):
    encoder = A.Encoder(vocabularies)
    assert encoder.ranks, "this vocabulary's merges are in the order of its ids"
    letters = range(0, 0x30000, 97)
    odd = [f"a{chr(c)}b1{chr(c)}2.{chr(c)}. {chr(c)} {chr(c)}x  {chr(c)}'s{chr(c)}" for c in letters if not 0xD800 <= c < 0xE000]
    for text in [*(t or "" for t in texts), *odd]:
        want = encoder.a.encode(" " + text, add_special_tokens=False).ids
        assert encoder.ids_a(" " + text) == want, repr(text)


def test_other_vocabularies_are_encoded_by_their_library(vocabularies):
    import copy
    import json

    other = copy.copy(vocabularies)
    told = json.loads(vocabularies.json)
    told["model"]["merges"][300:302] = told["model"]["merges"][301:299:-1]
    other.json = json.dumps(told)
    encoder = A.Encoder(other)
    assert encoder.ranks is None and len(encoder.encode("the words of it")[0]) >= 4


def test_diagonals_give_equal_work_and_keep_equal_ends_together():
    draw = random.Random(8)
    for _ in range(200):
        a, b = (np.array(sorted(draw.sample(range(60), draw.randint(0, 30)))) for _ in range(2))
        size = draw.randint(1, 9)
        path = A.diagonals(a, b, size)
        assert path[0] == (0, 0) and path[-1] == (len(a), len(b))
        for (i0, j0), (i1, j1) in zip(path, path[1:], strict=False):
            assert i0 <= i1 and j0 <= j1 and i1 + j1 - i0 - j0 <= size + 1
            before, behind = [*a[:i1], *b[:j1]], [*a[i1:], *b[j1:]]
            assert not before or not behind or max(before) < min(behind)


def test_pairs_are_bounded_by_the_vocabularies(spark, texts, vocabularies):
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    pieces = A.token_pieces(docs, vocabularies)
    counts = A.pair_counts(pieces, vocabularies)
    of_a, of_b = vocabularies.token_bytes()
    for r in counts.collect():
        one, other = of_a[r["pair"] >> 32], of_b[r["pair"] & 0xFFFFFFFF]
        assert one.endswith(other) or other.endswith(one)
    assert counts.count() < vocabularies.most_pairs() < A.MOST_PAIRS
    with pytest.raises(ValueError, match="over the bound"):
        A.align(pieces, counts, vocabularies, most_pairs=10)


def test_empty_table(spark, vocabularies):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert A.align_documents(docs, vocabularies=vocabularies).collect() == []
