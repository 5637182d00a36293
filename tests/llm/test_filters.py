"""Decontamination, quality rules, quality classifier and mixing against plain Python on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from motorwatch.llm import decontamination, mixing, quality_classifier, quality_rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, source string, n_words int, row string, `a.b` string"


def words_of(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def documents(frame, texts, sources=None):
    """Documents with extra columns whose names clash with the results'."""
    rows = [(i if i != 3 else None, t, (sources or ["s"] * len(texts))[i], -1, "x", None) for i, t in enumerate(texts)]
    return frame(rows, DOCS)


# ----------------------------------------------------------- decontamination


def brute_hits(text, items, width):
    words, hit, found = words_of(text), set(), set()
    for item_id, item in items:
        item = words_of(item)
        n = min(width, len(item))
        for k in range(len(item) - n + 1 if item else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == item[k : k + n]:
                    hit.update(range(at, at + n))
                    found |= {str(item_id)} - {"None"}
    return len(words), sorted(hit), sorted(found)


@pytest.fixture
def contamination_case():
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)] + ["Ä", "x9"]
    texts = ["", None, "  ...  ", "w1", *(" ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 60))) for _ in range(60))]
    items = [(1, "W1 w2, w3! w4"), (1, "w5 w6 w7"), (20, "w1 w1"), (None, "w9 w9 w9"), (3, None), (4, "..."), (5, "w1 w1"), (6, "w2 w3 w4 w5 w6 Ä")]
    texts += [" ".join(["zz"] * 5000) + " w5-w6;w7 " + "zz " * 20, "w1 w1 w1", "w1 w1 w1"]
    return texts, items


@pytest.mark.parametrize("limit", [16 << 20, 300])
def test_hits_equal_brute_force_whatever_the_broadcast_bound(frame, contamination_case, limit):
    texts, items = contamination_case
    found = decontamination.decontaminate(
        documents(frame, texts), frame(items, "item_id bigint, text string"), width=3, broadcast_bytes=limit
    )
    got = Counter((r["row"]["text"], r["n_words"], tuple(r["hits"]), tuple(r["items"]), r["contaminated"]) for r in found.collect())
    want = Counter()
    for text in texts:
        n, hits, names = brute_hits(text, items, 3)
        want[text, n, tuple(hits), tuple(names), bool(hits) and 20 * len(hits) >= n] += 1
    assert got == want


def test_clean_and_cut_texts(frame):
    docs = documents(frame, ["one two three four", "A b c, d! e f g h", None, "x"])
    found = decontamination.decontaminate(docs, frame([(1, "b c d"), (2, "g H")], "item_id bigint, text string"))
    assert {r["text"] for r in decontamination.clean(found).collect()} == {"one two three four", None, "x"}
    assert decontamination.clean(found).columns == docs.columns
    kept = {r["row"]["text"]: r["kept_text"] for r in decontamination.without_spans(found).collect()}
    assert kept == {"one two three four": "one two three four", "A b c, d! e f g h": "A ! e f ", None: None, "x": "x"}


def test_empty_tables_decontaminate(frame):
    docs, none = documents(frame, ["a b"]), frame([], "item_id bigint, text string")
    assert decontamination.decontaminate(docs, none).first()["hits"] == []
    assert decontamination.decontaminate(docs.limit(0), none).count() == 0


# -------------------------------------------------------------- quality rules


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            inside.update(range(i, i + 8))
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside),
    }


def rule_texts():
    draw = random.Random(9)
    some = [" ".join(draw.choice("abcdé") for _ in range(draw.randint(1, 90))) for _ in range(30)]
    lines = ["\n".join(draw.choice(["a b", "c", " ", "", "a b ", "\x0b"]) for _ in range(12)) for _ in range(10)]
    phrase = "one two three four five six seven eight nine"
    edge = [" ".join(["the of and to"] * k) for k in (2, 3, 4, 5)]
    return ["", None, " \n\t", phrase, phrase + " x " + phrase, "w " * 30, "a b # <|> 😀", "é" * 5000, phrase + " " + "lorem " * 4000, *edge, *some, *lines, *lines[:2]]


def test_measures_equal_brute_force(frame):
    rows = quality_rules.judge(documents(frame, rule_texts())).collect()
    names = list(brute_measures(""))
    got = Counter((r["row"]["text"], *(r[n] for n in names), r["base_failed"]) for r in rows)
    want = Counter()
    for text in rule_texts():
        m = brute_measures(text)
        want[text, *m.values(), m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]] += 1
    assert got == want
    assert all(not (r["kept"] and r["base_failed"]) for r in rows)


def brute_em(votes, rounds):
    """Expectation-maximisation over single documents, nothing grouped."""
    good = [(v.count("1") + 1) / (v.count("1") + 2 * v.count("0") + 2) for v in votes]
    for _ in range(rounds):
        prior = (sum(good) + 1) / (len(votes) + 2)
        table = []
        for r in range(len(votes[0])):
            counts = {k: [1 + sum(1 - g for g, v in zip(good, votes, strict=True) if v[r] == k), 1 + sum(g for g, v in zip(good, votes, strict=True) if v[r] == k)] for k in "01-"}
            ends = [sum(c[i] for c in counts.values()) for i in (0, 1)]
            table.append({k: (c[0] / ends[0], c[1] / ends[1]) for k, c in counts.items()})
        good = []
        for v in votes:
            yes, no = math.log(prior), math.log(1 - prior)
            for t, k in zip(table, v, strict=True):
                no, yes = no + math.log(t[k][0]), yes + math.log(t[k][1])
            good.append(1 / (1 + math.exp(no - yes)))
    return good


def test_posterior_equals_brute_force(frame):
    rows = quality_rules.judge(documents(frame, rule_texts()), rounds=12).collect()
    want = brute_em([r["votes"] for r in rows], 12)
    assert [r["quality"] for r in rows] == pytest.approx(want, abs=1e-9)
    assert [r["kept"] for r in rows] == [not r["base_failed"] and q >= 0.5 for r, q in zip(rows, want, strict=True)]


def test_estimation_recovers_accuracies():
    draw = random.Random(2)
    accuracy, votes = (0.95, 0.85, 0.75, 0.9), []
    for _ in range(20000):
        y = draw.random() < 0.7
        votes.append("".join("-" if draw.random() < 0.2 else "01"[y == (draw.random() < a)] for a in accuracy))
    prior, tables = quality_rules.estimate(sorted(Counter(votes).items()), 200)
    assert prior == pytest.approx(0.7, abs=0.03)
    for a, t in zip(accuracy, tables, strict=True):
        assert t["1"][1] / (t["1"][1] + t["0"][1]) == pytest.approx(a, abs=0.03)


def test_rules_run_without_python_and_without_rows(frame, plan):
    docs = documents(frame, ["a b c"])
    assert "Python" not in plan(quality_rules.judge(docs)) and "Arrow" not in plan(quality_rules.judge(docs))
    assert quality_rules.judge(docs.limit(0)).count() == 0


# --------------------------------------------------------- quality classifier


def test_classifier_on_held_out_rows(frame, spark):
    draw = random.Random(1)
    def text(good):
        return " ".join(draw.choice("abcdefgh") * draw.randint(1, 4) + ("" if good else draw.choice(["!!", "***"])) for _ in range(30))

    rows = [(i, text(i % 3 > 0), "s", 0, "x", None) for i in range(400)] + [(900, None, "s", 0, "x", None), (901, "", "s", 0, "x", None), (None, "a", "s", 0, "x", None)]
    docs = frame(rows, DOCS)
    labels = frame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(5, None, 0), (None, 1, 0), (7, 2, 1)], "doc_id bigint, quality int, toxic int")
    weights = quality_classifier.train(docs, labels)
    scored = quality_classifier.score(docs, weights).select("row.doc_id", "score", "predicted", quality_classifier.held_out(F.col("row.doc_id")).alias("h"))
    got = {r["doc_id"]: r for r in scored.collect()}
    assert len(got) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert {i for i in range(400) if got[i]["h"]} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    held = [got[i] for i in range(400) if got[i]["h"]]
    assert sum((r["score"] > 0.5) == (r["doc_id"] % 3 > 0) for r in held) >= 0.97 * len(held)
    # Held-out labels do not reach the model.
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(weights, quality_classifier.train(docs, flipped))
    assert got[900]["score"] == got[901]["score"]


def test_the_driver_reads_weights_without_an_object_for_each(frame):
    docs = frame([(i, f"w{i % 7} good" if i % 2 else f"w{i % 7} bad !!", "s", 0, "x", None) for i in range(40)], DOCS)
    labels = frame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    tracemalloc.start()
    try:
        weights = quality_classifier.train(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert weights.shape == (1 + (1 << quality_classifier.BITS),) and weights.any()
    assert peak < 32e6


def test_classifier_without_labels(frame):
    docs, labels = documents(frame, ["a", None]), frame([], "doc_id bigint, quality int, toxic int")
    weights = quality_classifier.train(docs, labels)
    assert {r["score"] for r in quality_classifier.score(docs, weights).collect()} == {0.5}
    assert quality_classifier.score(docs.limit(0), weights).count() == 0


def test_ftrl_equals_its_definition():
    draw = np.random.default_rng(5)
    model, z, n = quality_classifier.Ftrl(4, 0.3, 1.0, 0.01, 0.1), [0.0] * 4, [0.0] * 4
    for _ in range(50):
        x, y = draw.normal(size=4), int(draw.integers(2))
        w = [0.0 if abs(zi) <= 0.01 else -(zi - math.copysign(0.01, zi)) / ((1 + math.sqrt(ni)) / 0.3 + 0.1) for zi, ni in zip(z, n, strict=True)]
        g = [(1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True)))) - y) * xi for xi in x]
        for i in range(4):
            s = (math.sqrt(n[i] + g[i] ** 2) - math.sqrt(n[i])) / 0.3
            z[i], n[i] = z[i] + g[i] - s * w[i], n[i] + g[i] ** 2
        model.learn(np.arange(4), x, y)
    assert model.z == pytest.approx(z) and model.n == pytest.approx(n)


# --------------------------------------------------------------------- mixing


def brute_mix(rows, budget, max_repeats, block, seed=7):
    draw = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:12], 16)
    tokens = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = Counter()
    docs = Counter()
    for (_, _, s), n in zip(rows, tokens, strict=True):
        total[s] += n
        docs[s] += 1
    everything = sum(total.values())
    budget = everything if budget is None else budget
    shares = {s: n / everything for s, n in total.items() if n}
    reads = lambda a: max(p ** (a - 1) for p in shares.values()) / sum(p**a for p in shares.values()) * budget / everything
    a = next((k for k in range(0, 10**6, 1000) if reads(k / 1e6) <= max_repeats), 10**6)
    a = next(k for k in range(max(a - 1000, 0), a + 1) if k == 10**6 or reads(k / 1e6) <= max_repeats)
    powers = {s: p ** (a / 1e6) for s, p in shares.items()}
    out = []
    for s in shares:
        ppb = round(powers[s] / sum(powers.values()) * 1e9)
        target, n_blocks = ppb * budget // 10**9, -(-(total[s] + docs[s]) // block)
        if target <= 0:
            continue
        dealt = {}
        for (i, t, x), n in zip(rows, tokens, strict=True):
            if x == s:
                d = draw(f"{seed}|{'' if i is None else i}")
                dealt.setdefault(d % n_blocks, []).append((d, str("" if i is None else i), n, hashlib.md5((t or "").encode()).hexdigest(), i))
        key = "n" if s is None else "s" + s
        for p in range((target - 1) // total[s] + 1):
            at = p * total[s]
            for b in sorted(dealt, key=lambda b: (draw(f"{seed}|{key}|{p}|{b}"), b)):
                for d in sorted(dealt[b], key=lambda d: d[:4]):
                    if at < target:
                        out.append((d[4], s, d[2], p, b, at / target, ppb))
                    at += d[2]
    return Counter(out)


@pytest.mark.parametrize(("budget", "repeats", "block"), [(None, 2.0, 50), (400, 3.0, 1 << 20), (9000, 2.0, 200)])
def test_mixture_equals_brute_force(frame, budget, repeats, block):
    draw = random.Random(3)
    rows = [(i, " ".join(["w"] * draw.randint(0, 40)), draw.choice(["big"] * 12 + ["mid"] * 3 + ["low", None])) for i in range(120)]
    rows += [(5, rows[5][1], rows[5][2]), (None, "x y", "big"), (300, None, "empty"), (301, "", "empty"), (302, "w " * 3000, "long")]
    mixed = mixing.mix(frame(rows, "doc_id bigint, text string, source string"), budget=budget, max_repeats=repeats, block_tokens=block)
    got = Counter((r["row"]["doc_id"], r["row"]["source"], r["n_tokens"], r["pass_no"], r["block"], r["position"], r["weight_ppb"]) for r in mixed.collect())
    assert got == brute_mix(rows, budget, repeats, block)


def test_exponents(frame):
    sources = frame([("a", 900), ("b", 90), ("c", 10), ("d", 0)], "key string, tokens bigint")
    entropy = lambda a: (lambda w: -sum(x / sum(w) * math.log(x / sum(w)) for x in w))([p ** (a / 1e6) for p in (0.9, 0.09, 0.01)])
    a = mixing.exponent(sources, 1000, target_entropy=0.8, max_repeats=1e9)
    assert entropy(a) >= 0.8 * math.log(3) > entropy(a + 1)
    assert mixing.exponent(sources, 1000, target_entropy=0.0, max_repeats=1e9) == 10**6
    assert mixing.exponent(sources, 1000, target_entropy=1.0, max_repeats=1.5) == mixing.exponent(sources, 1000, max_repeats=1.5)
    assert mixing.exponent(sources, 10**6, max_repeats=2.0) == 10**6
    assert mixing.exponent(sources, 1000, max_repeats=1e9) == 0
    assert mixing.exponent(sources.limit(0), 0) == 10**6


def test_mixture_of_nothing(frame):
    assert mixing.mix(frame([], "doc_id bigint, text string, source string")).count() == 0
    assert mixing.mix(frame([(1, None, None)], "doc_id bigint, text string, source string")).count() == 0
