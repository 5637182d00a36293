"""Similarity join, connected components and repeated strings against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from motorwatch.llm import components, lsh_forest, suffix_array

DOCS = "doc_id bigint, text string, node string, class string, `key` int"


def documents(frame, texts):
    return frame([(i, t, "x", None, 1) for i, t in enumerate(texts)], DOCS)


# ----------------------------------------------------------------- components


def test_components_equal_union_find(frame):
    draw = random.Random(8)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, i) for i in range(2001, 2060)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["component"] for r in components.connected_components(frame(edges, "a bigint, b bigint"), "a", "b").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components.connected_components(frame([], "a bigint, b bigint"), "a", "b").count() == 0


# ------------------------------------------------------------ similarity join


def shingles(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def brute_classes(texts):
    different = sorted({t or "" for t in texts})
    sets = {t: shingles(t) for t in different}
    near = {t: {u for u in different if u != t and sets[t] and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u]) - 1e-12} for t in different}
    out, seen = {}, {}
    for t in different:
        if t in seen:
            continue
        stack, group = [t], {t}
        while stack:
            for u in near[stack.pop()] - group:
                group.add(u)
                stack.append(u)
        ids = [i for i, x in enumerate(texts) if (x or "") in group]
        for u in group:
            seen[u] = min(ids)
    counts = Counter(t or "" for t in texts)
    for i, t in enumerate(texts):
        t = t or ""
        out[i] = (seen[t], len(near[t]), counts[t])
    return out


def near_copies():
    draw = random.Random(6)
    texts = ["", None, "...", "One two", "one TWO!", "one two three"]
    for size in (30, 80, 200):
        base = [f"w{draw.randint(0, 400)}" for _ in range(size)]
        for _ in range(14):
            words = list(base)
            for _ in range(draw.randint(0, size // 18)):
                words[draw.randrange(size)] = f"z{draw.randint(0, 99)}"
            texts.append(" ".join(words))
        texts += [" ".join(base)] * 4
    return texts + [" ".join(f"q{draw.randint(0, 300)}" for _ in range(60)) for _ in range(20)] + ["very " * 30000]


@pytest.mark.parametrize("block", [256, 5])
def test_classes_and_links_equal_brute_force(frame, block):
    texts = near_copies()
    got = {r["id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in lsh_forest.similarity_classes(documents(frame, texts), block=block).collect()}
    assert got == brute_classes(texts)


def test_one_document_of_each_class_stays(frame):
    texts = near_copies()
    docs = documents(frame, texts)
    kept = lsh_forest.one_per_class(docs.unionByName(docs.where("doc_id in (0, 3, 7)")))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _, _ in brute_classes(texts).values()})


def test_null_ids_and_no_documents(frame):
    docs = frame([(None, "a b", 1), (None, "a b", 1), (4, "c d", 1), (None, "c d", 1)], "doc_id bigint, text string, n int")
    assert Counter(tuple(r) for r in lsh_forest.similarity_classes(docs).collect()) == {(None, None, 0, 2): 2, (4, 4, 0, 2): 1, (None, 4, 0, 2): 1}
    assert Counter(r["doc_id"] for r in lsh_forest.one_per_class(docs).collect()) == {None: 1, 4: 1}
    assert lsh_forest.similarity_classes(docs.limit(0)).count() == 0
    assert lsh_forest.one_per_class(docs.limit(0)).count() == 0


def test_prefixes_are_shortened_until_the_recall_is_met():
    depth = lsh_forest.prefix_depth(40, 0.8, 0.9999)
    assert 1 - (1 - 0.8**depth) ** 40 >= 0.9999 > 1 - (1 - 0.8 ** (depth + 1)) ** 40
    assert lsh_forest.prefix_depth(40, 0.8, 0.5) > depth > lsh_forest.prefix_depth(4, 0.8, 0.9999)


def test_label_collisions_follow_the_similarity():
    draw = np.random.default_rng(3)
    forest, same = lsh_forest.Forest(1000, 1), []
    common = draw.integers(0, 1 << 63, size=800, dtype=np.uint64)
    a, b = (np.concatenate([common, draw.integers(0, 1 << 63, size=100, dtype=np.uint64)]) for _ in range(2))
    same = np.mean(np.array(forest(a)) == np.array(forest(b)))
    assert same == pytest.approx(0.8, abs=0.05)


@given(st.lists(st.sets(st.integers(0, 30)), min_size=1, max_size=8), st.lists(st.sets(st.integers(0, 30)), min_size=0, max_size=8))
@settings(max_examples=60, deadline=None)
def test_common_counts(left, right):
    pack = lambda sets: [np.array(sorted(s), dtype=np.uint64) for s in sets]
    a, b = pack(left), pack(right)
    if right:
        assert lsh_forest.common_counts(a, b).tolist() == [[len(x & y) for y in right] for x in left]
    own = lsh_forest.common_counts(a, a)  # its diagonal has no use
    assert all(own[i, j] == len(x & y) for i, x in enumerate(left) for j, y in enumerate(left) if i != j)


# ----------------------------------------------------------- repeated strings


def brute_cut(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = Counter()
    for d in data:
        mask = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        runs = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        out[d, sum(mask), runs, bytes(c for c, m in zip(d, mask, strict=True) if not m)] += 1
    return out


def repeat_texts():
    draw = random.Random(5)
    sentence = lambda n: "".join(draw.choice("abcdeé ") for _ in range(n))
    passages = [sentence(n) for n in (25, 60, 150, 33, 21)]
    texts = ["", None, "short", "a" * 90, "ab" * 70, "xyz" * 30 + "q" + "xyz" * 30, "é" * 40]
    for _ in range(60):
        parts = [sentence(draw.randint(0, 40))]
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(passages)
            cut = draw.randint(0, 10)
            parts += [p[cut : len(p) - draw.randint(0, 10)], sentence(draw.randint(0, 30))]
        texts.append("".join(parts))
    return texts + texts[20:24] + [texts[30]] * 3


@pytest.mark.parametrize(("length", "kmer", "period", "cover"), [(20, 12, 7, (0, 1, 3)), (20, 20, 3, (1, 2)), (31, 20, 13, (0, 1, 3, 9))])
def test_cuts_equal_brute_force(frame, length, kmer, period, cover):
    texts = repeat_texts()
    found = suffix_array.remove_repeats(documents(frame, texts), length=length, kmer=kmer, period=period, cover=cover).collect()
    assert all(r["n_bytes"] == len((r["row"]["text"] or "").encode()) and r["kept_sha256"] == hashlib.sha256(r["kept"]).hexdigest() for r in found)
    got = Counter(((r["row"]["text"] or "").encode(), r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found)
    assert got == brute_cut(texts, length)


def test_production_parameters_on_a_small_table(frame):
    draw = random.Random(2)
    text = lambda n: " ".join(f"{draw.randint(0, 10**6)}é" for _ in range(n))
    shared = text(70)
    texts = [text(90), text(40) + shared + text(50), shared[:420] + text(9), text(30) + shared[30:], shared, shared, "k" * 399, "m" * 401, None]
    got = Counter(((r["row"]["text"] or "").encode(), r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_array.remove_repeats(documents(frame, texts)).collect())
    assert got == brute_cut(texts, 400)


def test_a_very_long_text_is_worked_on_in_pieces(frame, monkeypatch):
    monkeypatch.setattr(suffix_array, "_CHUNK", 100)
    texts = ["".join(random.Random(7).choice("abc") for _ in range(2000)), "b" * 500, None]
    got = Counter(((r["row"]["text"] or "").encode(), r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_array.remove_repeats(documents(frame, texts), length=9, kmer=6, period=3, cover=(1, 2)).collect())
    assert got == brute_cut(texts, 9)


def test_units_are_shuffled_once_a_step(frame, plan, monkeypatch):
    plans, keep = [], suffix_array.Stages.keep

    def kept(self, df, label):
        if any("/units-" in path for path in df.inputFiles()):
            plans.append(plan(df))
        return keep(self, df, label)

    monkeypatch.setattr(suffix_array.Stages, "keep", kept)
    assert suffix_array.remove_repeats(documents(frame, repeat_texts()[:8]), length=20, kmer=12, period=7, cover=(0, 1, 3)).columns
    assert plans and all(text.count("Exchange hashpartitioning") <= 2 for text in plans)


def test_equal_units_of_a_text_are_one_row(frame, monkeypatch):
    draw = random.Random(11)
    word = lambda n: "".join(draw.choice("abcdeé ") for _ in range(n))
    line = word(14)
    texts = [line * n + word(30) for n in (40, 90, 160)] + [word(25) + line * 12 + word(25), line * 160, word(80), "ab" * 30 + word(20) + "ab" * 40, word(12) * 2]
    rows, keep = {}, suffix_array.Stages.keep

    def kept(self, df, label):
        out = keep(self, df, label)
        rows[label] = out.collect()
        return out

    monkeypatch.setattr(suffix_array.Stages, "keep", kept)
    found = suffix_array.remove_repeats(documents(frame, texts), length=20, kmer=12, period=7, cover=(0, 1, 3)).collect()
    assert Counter(((r["row"]["text"] or "").encode(), r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found) == brute_cut(texts, 20)
    units = Counter((r["node"], r["fp"], r["h"]) for r in rows["units"] if r["fp"] is not None)
    assert units and max(units.values()) == 1
    # What is joined does not grow with the repeats of a line in a text.
    assert len(rows["alike"]) < 200 and len(rows["seen"]) < 200


def test_counted_units_are_those_of_a_list():
    draw = random.Random(12)
    for _ in range(60):
        node, fp, h = (np.array([draw.randrange(k) for _ in range(size)], dtype=np.int64) for size in [draw.randint(0, 25)] for k in (2, 2, 3))
        node.sort()
        b = np.cumsum([draw.randint(1, 3) for _ in node]).astype(np.int64)
        a = np.concatenate([[0], b[:-1]]).astype(np.int64)[: len(b)]
        rows, runs = suffix_array.counted(node, fp, h, a, b)
        want = Counter(zip(node.tolist(), fp.tolist(), h.tolist(), strict=True))
        assert {x[:3]: x[5] for x in zip(*map(np.ndarray.tolist, rows), strict=True)} == want and len(rows[0]) == len(want)
        assert all((n, f, g, x, y) in set(zip(*(c.tolist() for c in (node, fp, h, a, b)), strict=True)) for n, f, g, x, y, _ in zip(*map(np.ndarray.tolist, rows), strict=True))
        windows = {(n, i) for n, f, g, x, y in zip(*(c.tolist() for c in (node, fp, h, a, b)), strict=True) if want[n, f, g] > 1 for i in range(x, y)}
        held = [(n, i) for n, x, y in zip(*map(np.ndarray.tolist, runs), strict=True) for i in range(x, y)]
        assert len(held) == len(windows) and set(held) == windows
        ends = Counter((n, y) for n, _, y in zip(*map(np.ndarray.tolist, runs), strict=True))
        assert not any((n, x) in ends for n, x, _ in zip(*map(np.ndarray.tolist, runs), strict=True))


def test_nothing_to_cut(frame):
    docs = documents(frame, ["a", None])
    assert [r["n_removed"] for r in suffix_array.remove_repeats(docs).collect()] == [0, 0]
    assert suffix_array.remove_repeats(docs.limit(0)).count() == 0


def test_the_cover_covers():
    for period, cover in ((suffix_array.PERIOD, suffix_array.COVER), (3, (1, 2)), (7, (0, 1, 3))):
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@given(st.binary(min_size=1, max_size=120), st.integers(1, 60))
@settings(max_examples=80, deadline=None)
def test_names_tell_strings_apart(data, length):
    if len(data) >= length:
        names = suffix_array.names_of(data, length).tolist()
        strings = [data[i : i + length] for i in range(len(data) - length + 1)]
        assert len(names) == len(strings) and len(set(names)) == len(set(strings)) == len(set(zip(names, strings, strict=True)))


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 20))
@settings(max_examples=120, deadline=None)
def test_equal_windows_have_equal_minimizers(values, width):
    if len(values) >= width:
        places = suffix_array.minimizer_places(np.array(values, dtype=np.uint64), width).tolist()
        assert all(i <= p < i + width for i, p in enumerate(places))
        seen = {}
        for i, p in enumerate(places):
            assert seen.setdefault(tuple(values[i : i + width]), p - i) == p - i


@given(st.lists(st.binary(max_size=40), max_size=6), st.integers(2, 12), st.integers(1, 12))
@settings(max_examples=120, deadline=None)
def test_units_hold_each_window_once(parts, length, kmer):
    if kmer > length:
        return
    number, fp, h, a, b = suffix_array.units_of(parts, length, kmer, suffix_array.Powers())
    windows = [(n, i) for n, x, y in zip(number, a, b, strict=True) for i in range(x, y)]
    assert sorted(windows) == [(n, i) for n, p in enumerate(parts) for i in range(len(p) - length + 1)]
    contents = {}
    for n, x, y, f, c in zip(number, a, b, fp, h, strict=True):
        contents.setdefault((f, c), set()).add(parts[n][x : y + length - 1])
    assert all(len(c) == 1 for c in contents.values())
