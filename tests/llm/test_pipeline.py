"""The registered queries against their SQL, and the pipeline against its parts."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
import oracle
from motorwatch.llm import decontamination
from motorwatch.llm.queries import QUERIES
from motorwatch.llm.sql import CHECKS
from test_copies import brute_classes
from test_filters import brute_hits, brute_mix

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(D)


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_its_sql(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, D), con, CHECKS[name]) == []


@pytest.mark.parametrize(("name", "table"), [("op4_html_extraction", "pages"), ("op5_quality_classifier", "documents"), ("op6_suffix_array", "documents"), ("op8_token_counts", "documents"), ("op13_token_alignment", "documents")])
def test_a_row_for_each_row(spark, name, table):
    assert QUERIES[name](spark, D).count() == spark.read.parquet(f"{D}/{table}.parquet").count()


def folder(frame, tmp_path, docs):
    """A folder of tables with these documents, an extra column clashing with the mixture's."""
    path = str(tmp_path)
    rows = [(i, t, "en", s, len(t) if t is not None else None, "x") for i, t, s in docs]
    frame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, mix_pass string").write.parquet(f"{path}/documents.parquet")
    frame([(i, int("!!" not in (t or "")), 0) for i, t, _ in docs if i is not None], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    frame([(1, " ".join(f"bench{i}" for i in range(20)))], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def sentence(seed, n=120):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i * seed) % 9973}" for i in range(n))


def test_each_stage_takes_effect(spark, frame, tmp_path):
    passage = sentence(999, 110)
    docs = [(i, sentence(i) + ".", "a" if i % 3 else "b") for i in range(120)]
    docs += [(200 + i, "!! ".join(sentence(300 + i).split()) + "!!", "a") for i in range(60)]
    docs += [(400, docs[7][1], "a"), (401, docs[7][1] + " more", "a"), (7, docs[7][1], "a")]
    docs += [(500, sentence(501) + "\n" + passage, "b"), (501, passage + "\n" + sentence(502), None)]
    docs += [(600, sentence(601, 60) + " " + " ".join(f"bench{i}" for i in range(20)), "a"), (None, sentence(700), "a")]
    path = folder(frame, tmp_path, docs)
    mixed = corpus_pipeline.run(spark, path).collect()
    assert {"b", "a", None} >= {r["source"] for r in mixed} and all(isinstance(r["mix_pass"], int) for r in mixed)

    kept = spark.read.parquet(f"{path}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, kept, path)
    left = {r["doc_id"]: r for r in kept.collect()}
    assert set(range(120)) | {None} <= set(left) and set(left) >= {r["doc_id"] for r in mixed}
    assert not set(left) & {400, 401, 600} and len(set(left) & set(range(200, 260))) <= 2
    assert passage[40:-40] not in left[500]["text"] and passage[40:-40] not in left[501]["text"]
    assert left[500]["n_chars"] == len(left[500]["text"]) and sentence(501)[:300] in left[500]["text"]


def test_stages_return_the_columns_of_documents(spark, frame, tmp_path):
    path = folder(frame, tmp_path, [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, None), (3, "", "s")])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            out = step(spark, given, path)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert out.count() <= given.count()
    assert corpus_pipeline.mixture(spark, docs.limit(0), path).count() == 0
    assert decontamination.clean(decontamination.decontaminate(docs, spark.read.parquet(f"{path}/benchmark.parquet"))).count() == 4


def brute_passages(texts, length=corpus_pipeline.PASSAGE_BYTES):
    """The texts without each character that has a byte in a string of this length that occurs again."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for text, d in zip(texts, data, strict=True):
        cut = set()
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                cut.update(range(i, i + length))
        left, at = [], 0
        for c in text or "":
            size = len(c.encode())
            if not cut & set(range(at, at + size)):
                left.append(c)
            at += size
        out.append(None if text is None else "".join(left))
    return out


def brute_pipeline(rows, items):
    """``rows``: id, text, source, as the classifier has let them through."""
    classes = brute_classes([t for _, t, _ in rows])
    rows = [r for i, r in enumerate(rows) if classes[i][0] == i]
    rows = [(i, t, s) for (i, _, s), t in zip(rows, brute_passages([t for _, t, _ in rows]), strict=True)]
    hits = [brute_hits(t, items, decontamination.WIDTH) for _, t, _ in rows]
    rows = [r for r, (n, hit, _) in zip(rows, hits, strict=True) if not (hit and 20 * len(hit) >= n)]
    texts = {i: t for i, t, _ in rows}
    mixed = brute_mix(rows, None, 2.0, 1 << 20)
    return Counter({(r[0], texts[r[0]], len(texts[r[0]]), *r[1:]): n for r, n in mixed.items()})


def test_pipeline_equals_brute_force(spark, frame, tmp_path):
    draw = random.Random(9)
    text = lambda n: " ".join(draw.choice("aeé�中😀") + str(draw.randint(0, 10**5)) for _ in range(n))
    passages = [text(70) for _ in range(3)]
    docs = [(i, text(draw.randint(5, 90)), draw.choice("aaab")) for i in range(40)]
    for i, (before, after) in enumerate([("é", "é"), ("ũ", "è"), ("中", "丮"), ("𐀭", "😀"), ("�", "�"), ("", "")] * 2, 40):
        docs.append((i, f"{text(60)}{before}{passages[i % 3]}{after}{text(60)}{passages[(i + 1) % 3][:500]}{after}", "a"))
    docs += [(60, docs[3][1], "a"), (61, docs[41][1] + " more", "b"), (62, "", "b"), (63, text(30) + " " + " ".join(f"bench{i}" for i in range(20)), "a")]
    docs += [(70 + i, "!! ".join(text(60).split()) + "!!", "a") for i in range(30)]
    path = folder(frame, tmp_path, docs)
    given = spark.read.parquet(f"{path}/documents.parquet")
    good = sorted((r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.good_quality(spark, given, path).collect())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    got = Counter(
        (r["doc_id"], r["text"], r["n_chars"], r["source"], r["mix_tokens"], r["mix_pass"], r["mix_block"], r["mix_position"], r["mix_weight_ppb"])
        for r in corpus_pipeline.run(spark, path).collect()
    )
    assert got == brute_pipeline(good, items)
    assert len(good) > 50 and any("�" in t and i >= 40 for i, t, *_ in got)
