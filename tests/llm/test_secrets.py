from __future__ import annotations

import random
import re

import pytest
from motorwatch.llm import secret_scan as S


def expected(text: str | None) -> list[tuple[int, int, int]]:
    """Spans by the definition: every window counted anew."""
    text = text or ""
    base = []
    for kind, (pattern, group, least) in enumerate(S.BASE.values()):
        base += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    found, sums = list(base), S.log_sums()
    for run in re.finditer(S.CANDIDATE, text):
        said = run[0]
        if any(re.search(a, said) for a in S.ALLOWED) or all(re.search(S.SLUG_PART, p) for p in re.split(S.SLUG_BREAK, said)):
            continue
        top = S.highest_sum(next(limit for pattern, limit in S.CLASSES.values() if re.search(pattern, said)))
        spans: list[list[int]] = []
        for at in range(len(said) - S.WINDOW + 1):
            window = said[at : at + S.WINDOW]
            if sum(sums[window.count(c)] for c in set(window)) <= top:
                if spans and at <= spans[-1][1]:
                    spans[-1][1] = at + S.WINDOW
                else:
                    spans.append([at, at + S.WINDOW])
        for a, b in spans:
            a, b = a + run.start(), b + run.start()
            if not any(x <= a and b <= y for x, _, y in base):
                found.append((a, 3, b))
    return sorted(found)


def random_text(draw: random.Random) -> str:
    def key(characters, longest):
        return "".join(draw.choice(characters) for _ in range(draw.randint(1, longest)))

    parts = []
    for _ in range(draw.randint(0, 12)):
        parts.append(
            draw.choice(
                [
                    key(S.ALPHABET, 60), key("0123456789abcdef", 50), "the-quick-fox-2020-jumps-over", "é😀", "ſecret token", "\n", "a b",
                    draw.choice(["token", "PassWord", "api_key", 'Secret="', "AKIA"]) + draw.choice(["", " : ", '="', "'= '"]) + key(S.ALPHABET[:62], 30),
                    "a" * 30 + "1" + key(S.ALPHABET, 30), '"', "tokeN ", "=",
                ]
            )
        )
    return draw.choice(["", " "]).join(parts)


def test_spans_equal_the_definition(spark):
    draw = random.Random(5)
    texts = [random_text(draw) for _ in range(150)]
    texts += [None, "", "x" * 3000, " ".join(f"token=abcdefgh{i}" for i in range(1200)), "".join(draw.choice(S.ALPHABET) for _ in range(3000))]
    texts += texts[:3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["row"]["doc_id"]: r for r in S.find_secrets(docs).collect()}
    assert len(got) == len(texts)
    added = 0
    for i, text in enumerate(texts):
        want = expected(text)
        assert [tuple(x) for x in got[i]["found"]] == want, text
        assert [got[i][f"n_{k}"] for k in S.BASE] == [sum(kind == at for _, kind, _ in want) for at in range(3)]
        added += sum(kind == 3 for _, kind, _ in want)
    assert added > 100


@pytest.mark.parametrize(
    "text",
    [
        "1234567890123456789012345", "some_long_function_name_of_a_module", "releases/2024-05/model-v12-notes", "123e4567-e89b-12d3-a456-426614174000",
        "AKQEXAMPLEKEY9f8s7d6f5g4h3j2k1", "zzzzzzzzzzzzzzzzzzzz1zzzzzzzzzzz",
    ],
)
def test_allow_list(spark, text):
    assert S.find_secrets(spark.createDataFrame([(text,)], "text string")).first()["found"] == []


def test_extra_patterns_are_allowed(spark):
    df = spark.createDataFrame([("see q8Zt3LmV0xKp7RsW2yBn ok",)], "text string")
    assert [tuple(x) for x in S.find_secrets(df).first()["found"]] == [(4, 3, 24)]
    assert S.find_secrets(df, allowed=(*S.ALLOWED, "^q8Z")).first()["found"] == []


def test_names_empty_tables_and_redaction(spark):
    rows = [("é token = abcdefgh1 x AKIAABCDEFGHIJKL", "k"), (None, "n")]
    df = spark.createDataFrame(rows, "found string, row string")
    scanned = S.find_secrets(df, text="found")
    got = scanned.select("row.row", S.listed(scanned["found"]).alias("spans")).collect()
    assert [tuple(r) for r in got] == [("k", "assign:2:19,access:22:38"), ("n", "")]
    assert [r["redacted"] for r in S.redact(scanned, "found").collect()] == ["é [SECRET] x [SECRET]", None]
    assert S.find_secrets(df.where("false"), text="found").collect() == []


def test_no_python_in_the_plan(spark, plan):
    text = plan(S.find_secrets(spark.createDataFrame([("a",)], "text string").where("text is not null")))
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text
