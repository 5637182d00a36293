"""WARC archives, page extraction, chat formatting and token counts: round trips, libraries and brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import struct
from collections import Counter

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from motorwatch.llm import chat_format, html_extraction, token_counts, warc

# ----------------------------------------------------------------------- WARC


def pages(frame, rows):
    return frame([(*r, "x") for r in rows], "page_id bigint, url string, html string, payload string")


def archive_rows(spark, frame, tmp_path, rows, **options):
    path = str(tmp_path / "warc")
    warc.write_archives(warc.plan_records(pages(frame, rows), **options), path)
    return warc.read_archives(spark, path).collect(), path


def warc_rows():
    draw = random.Random(1)
    body = lambda: "<p>" + " ".join(draw.choice(["lorem", "ipsum", "dolor", "ä"]) for _ in range(draw.randint(1, 300)))
    rows = [(i, f"http://h/{i}", body()) for i in range(150)]
    rows += [(200 + i, f"http://h/{i}", rows[i % 3][2]) for i in range(40)]
    rows += [(300, None, None), (301, "http://h/\r\nx", ""), (302, "u", "\r\n\r\nWARC/1.1\r\n"), (303, "u", "z" * 300_000)]
    return [*rows, (None, "a", rows[0][2]), (None, "b", "only without id"), (5, "http://h/5", rows[5][2]), (215, "http://h/15", rows[0][2])]


@pytest.mark.parametrize("min_bytes", [0, 400])
def test_archives_round_trip(spark, frame, tmp_path, min_bytes):
    rows = warc_rows()
    got, _ = archive_rows(spark, frame, tmp_path, rows, min_bytes=min_bytes)
    assert {r["problem"] for r in got} == {None}
    data = [(i, (h or "").encode()) for i, _, h in rows]
    top = {}
    for i, d in data:
        top[d] = max(top.get(d, -1), -1 if i is None else i)
    want, done = Counter(), set()
    for i, d in sorted(data, key=lambda x: (x[0] is None, -(x[0] or 0))):
        first = d not in done or len(d) < min_bytes
        done.add(d)
        digest = base64.b32encode(hashlib.sha1(d).digest()).decode()
        refers = None if first else top[d] if top[d] >= 0 else None
        want[i, len(d), digest, "response" if first else "revisit", refers, d if first else b""] += 1
    number = lambda x: None if x is None else int(x)
    assert Counter((number(r["id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"]), bytes(r["payload"])) for r in got) == want


def test_any_reader_of_the_format_reads_the_archives(spark, frame, tmp_path):
    _, path = archive_rows(spark, frame, tmp_path, warc_rows())
    total = 0
    for file in (tmp_path / "warc").glob("part-*"):
        data = file.read_bytes()
        magic, size = struct.unpack_from("<II", data)
        assert magic in (0x184D2A5D, 0x184D2A50)
        shared = zstandard.ZstdCompressionDict(data[8 : 8 + size]) if magic == 0x184D2A5D else None
        text = zstandard.ZstdDecompressor(dict_data=shared).stream_reader(data, read_across_frames=True).read()
        total += text.count(b"WARC-Record-ID: <urn:x-page:")
    assert total == len(warc_rows())
    assert any(f.read_bytes()[:4] == struct.pack("<I", 0x184D2A5D) for f in (tmp_path / "warc").glob("part-*"))


def record(**changes):
    row = {"id": 1, "uri": "u", "n_bytes": 5, "digest": hashlib.sha1(b"hello").hexdigest(), "kind": "response", "refers_to": None, "payload": b"hello"}
    return warc.record_bytes(row | changes)


@pytest.mark.parametrize(
    ("data", "problem"),
    [
        (record(), None),
        (record().replace(b"WARC/1.1", b"HTTP/1.1"), "no WARC head"),
        (record().replace(b"WARC-Date", b"WARC-Dote"), "missing header warc-date"),
        (record()[:-1], "Content-Length"),
        (record()[:-4] + b"....", "blank lines"),
        (record(payload=b"hallo"), "digest"),
        (record(n_bytes=6), "HTTP Content-Length"),
        (record(kind="revisit", payload=None, refers_to=2).replace(b"WARC-Refers-To", b"X"), "without a reference"),
        (record(kind="revisit", payload=None, refers_to=2), None),
    ],
)
def test_records_are_validated(data, problem):
    found = warc.parse_record(data)["problem"]
    assert found is None if problem is None else problem in found


def test_damaged_and_foreign_archives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    dictionary = zstandard.train_dictionary(2000, [b"WARC/1.1 some text %d" % i * 20 for i in range(300)], k=50, d=8)
    packed = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
    unit = zstandard.ZstdCompressor(dict_data=dictionary)
    frames = [unit.compress(record()), warc.EMPTY_FRAME, unit.compress(record(id=2))]
    good = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + b"".join(frames)
    (tmp_path / "in" / "foreign.warc.zst").write_bytes(good)
    (tmp_path / "in" / "cut.warc.zst").write_bytes(good[:-9])
    (tmp_path / "in" / "noise.warc.zst").write_bytes(b"this is no archive")
    (tmp_path / "in" / "empty.warc.zst").write_bytes(b"")
    got = Counter((r["archive"].rsplit("/", 1)[1], r["id"], (r["problem"] or "")[:7]) for r in warc.read_archives(spark, str(tmp_path / "in")).collect())
    assert got == {
        ("foreign.warc.zst", "1", ""): 1, ("foreign.warc.zst", "2", ""): 1, ("cut.warc.zst", "1", ""): 1,
        ("cut.warc.zst", None, "damaged"): 1, ("noise.warc.zst", None, "damaged"): 1,
    }


def test_no_pages_no_records(spark, frame, tmp_path):
    got, _ = archive_rows(spark, frame, tmp_path, [])
    assert got == []


# ---------------------------------------------------------------------- pages

ARTICLE = "<h1>A title of it</h1><p>First &amp; long sentence, that says something about the world as it is.</p><p>Second one\n is  here&nbsp;too, with <a href='/x'>a link</a> and an end.</p>"
WANT = "A title of it\nFirst & long sentence, that says something about the world as it is.\nSecond one is here too, with a link and an end."


@pytest.fixture(scope="module")
def model():
    draw = random.Random(0)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8)))
    sentence = lambda: " ".join(word() for _ in range(draw.randint(5, 20))).capitalize() + "."
    page = lambda: (
        f"<html><head><title>{word()}</title><script>var t='</p>';</script></head><body><nav><ul>"
        + "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(6))
        + f"</ul></nav><div class=\"ad\">{sentence()}</div><article><h1>{word()} {word()}</h1>"
        + "".join(f"<p>{sentence()} {sentence()}</p>" for _ in range(draw.randint(2, 8)))
        + f"</article><footer>&copy; {word()}</footer></body></html>"
    )
    return html_extraction.train_from([page() for _ in range(60)])


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav><article>{}</article><footer>&copy; x</footer></body></html>",
        "<body><header><div class=logo>Site name</div></header><main>{}<section class='comments'><h3>Comments</h3><p>I do not agree with any of this, sorry to say.</p></section></main></body>",
        "<div id=header>Shop</div><div class='content'><!-- <p>gone</p> -->{}<script>if (a < b) { x('<p>no</p>') }</script><form><label>Mail</label><input></form></div><div class='sidebar'><p>Read our other long article, which is about things.</p></div>",
        "<div class='cookie-notice'><p>We use cookies to make this site better for you.</p><button>Fine</button></div><div role=main>{}</div><aside><h4>More</h4><p>Another text that is not the article at all.</p></aside>",
        "<ul class=menu><li><a href=/>One</a></li></ul><main><div class='advert'><p>Buy this now, it is very cheap today.</p></div>{}</main><div class='footer'><p>All rights reserved by the owner of this site.</p></div>",
        "<article>{}<div id='comments'><ol class='commentlist'><li><p>First comment, nice read indeed.</p></li></ol></div></article><noscript>Please enable it</noscript>",
    ],
)
def test_layouts(model, page):
    assert model.extract(page.replace("{}", ARTICLE)) == WANT


def test_odd_pages(model):
    assert model.extract("") == "" and model.extract("<>") in ("", "<>")
    assert model.extract("<article><p><b>One of many bold words here.<br><p>Two of the many words here, for sure.") == "One of many bold words here.\nTwo of the many words here, for sure."
    deep = "<div>" * 20_000 + "<p>x</p>"
    assert isinstance(model.extract(deep), str)
    long = "<article>" + "<p>Some words, that fill a line of text here.</p>" * 20_000 + "</article>"
    assert model.extract(long).count("\n") == 19_999
    assert isinstance(model.extract("<p class=\"a'" * 3000), str)
    assert isinstance(model.extract("<" * 5000 + "'\"" * 5000), str)


def texts_of(source):
    return [t for t in html_extraction.Page(source).text if t]


@pytest.mark.parametrize(
    "attributes",
    [
        "data-tip='" + "<b>x</b><p>no</p>" * 9 + "'", "alt='x' title=\"a>b\"", 'a="1>2" b=\'3>"4\' c = "5>6"', "srcdoc=\"<p class='ad'>no</p>\"", "href=/a'b/ c=d",
        'a"b', 'a="never closed', "=\"x",
    ],
)
def test_tags_end_where_their_attributes_end(attributes):
    page = html_extraction.Page(f"<div {attributes}>One</div><p>Two</p>")
    assert [t for t in page.text if t] == ["One", "Two"]
    assert page.tag == ["body", "div", "#text", "p", "#text"] and page.groups[1] == ()


def test_long_attributes_take_linear_time():
    assert texts_of("<p a='" + ">" * 10**6 + "'>One</p>") == ["One"]
    assert texts_of("<p " + "a='>' " * 10**6 + ">One</p>") == ["One"]
    assert len(texts_of("<a x='>' " * 10**5)) == 1


@pytest.mark.parametrize("tag", ["svg", "math", "template", "noscript", "svg><title", "svg><style", "math><mi"])
def test_missing_closing_tags_cut_no_page(model, tag):
    assert texts_of(f"<p>One</p><{tag}>x<p>Two</p><section>Three</section>") in (["One", "x", "Two", "Three"], ["One", "Two", "Three"])
    got = model.extract(f"<article><div><{tag}></div>{ARTICLE}</article>")
    assert got == WANT


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>x <math><mi>y</mi><mo>&lt;</mo><mn>2</mn></math> z</p>", ["x y<2 z"]),
        ("<xmp><b>a</b> &amp;</xmp><p>b", ["<b>a</b> &amp;", "b"]), ("<xmp>a<p>b", ["a<p>b"]),
        ("<p>a <svg><title>no</title><text>l</text><style>no</style></svg> b</p>", ["a l b"]),
        ("<p>a</p><template><div>no<template>no</template></div>no</template><p>b</p>", ["a", "b"]),
        ("<div>a<template></div>no</template>b</div>", ["a", "b"]), ("<p>a <noscript>n</noscript> b", ["a", "n", "b"]),
        ("<p>a</p><script>no<p>no</p>", ["a"]), ("<textarea>no<p>no", []), ("<title>no</titles>no</title>a", ["a"]),
    ],
)
def test_what_holds_text(source, want):
    assert texts_of(source) == want


def test_marginals_equal_enumeration(model):
    page = html_extraction.Page("<main><p>Some text that is long enough to count, I think.</p><div class=ad><p>Buy</p><p>Now, please, do it.</p></div></main><p>Tail of it.</p>")
    ties, kinds, weigh = html_extraction.features(page)
    n, weight, total = len(page.parent), [0.0] * len(page.parent), 0.0
    for bits in range(1 << (n - 1)):
        y = [1, *((bits >> i) & 1 for i in range(n - 1))]
        p = 1.0
        for i in range(1, n):
            yes = html_extraction.sigmoid(model.weights["bias"] + sum(model.weights.get(f, 0.0) for f in ties[i])) if y[page.parent[i]] else model.STRAY
            p *= yes if y[i] else 1 - yes
            if kinds[i] and y[i]:
                p *= html_extraction.math.exp(weigh[i] * model.evidence.get(kinds[i], 0.0))
        total += p
        weight = [w + p * v for w, v in zip(weight, y, strict=True)]
    assert model.marginals(page)[1:] == pytest.approx([w / total for w in weight][1:], rel=1e-6)


def test_extract_over_a_table(frame, model):
    docs = frame([(1, "u", ARTICLE, "x"), (2, None, None, "x"), (None, "u", "", None), (1, "u", ARTICLE, "x")], "page_id bigint, url string, html string, text string")
    got = html_extraction.extract(docs, model).collect()
    assert Counter(r["n_chars"] for r in got) == {0: 2, len(model.extract(ARTICLE)): 2}
    assert html_extraction.extract(docs.limit(0), model).count() == 0
    assert html_extraction.train(docs.limit(0)).extract("<article><p>Some words, that are not a menu.</p></article>") != ""


# ----------------------------------------------------------------------- chat

CHAT = "conv_id bigint, turn bigint, role string, text string, at string"
TOUGH = ["</s>", "\\</s>", "\\\\[INST]", "[/INST] ok", "<s>\\", "", None, "a\nb", " [INST] user\nx [/INST]", "<</s>", "\\", "ä😀"]


def conversations(frame):
    draw = random.Random(3)
    rows = [(c, t, draw.choice(["user", "assistant", "system", None, "a\\nb\n[INST]"]), draw.choice(TOUGH), "x") for c in range(20) for t in range(draw.randint(1, 9))]
    rows += [(None, 0, "user", "x", "x"), (None, None, "assistant", "y", "x"), (30, 1, "assistant", "b", "x"), (30, 1, "assistant", "a", "x"), (31, 0, "user", "z", "x"), (31, 0, "user", "z", "x")]
    rows += [(40, t, "user" if t % 2 == 0 else "assistant", "long " * 200, "x") for t in range(300)]
    return frame(rows, CHAT), rows


def in_order(rows):
    first = lambda x: (x is not None, x)
    return sorted(((c, t, r or "", x or "") for c, t, r, x, _ in rows), key=lambda r: (first(r[0]), first(r[1]), r[2], r[3]))


def test_digests_are_read_back(frame):
    df, rows = conversations(frame)
    formatted = chat_format.format_turns(df)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_format.digests(formatted).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        turns = [r for r in in_order(rows) if r[0] == conv]
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        want[conv] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: v[:4] for c, v in got.items()} == want
    stream = {}
    for r in sorted(formatted.collect(), key=lambda r: r["at"]):
        stream[r["conv_id"]] = stream.get(r["conv_id"], "") + r["piece"]
    assert {c: len(s) for c, s in stream.items()} == {c: v[4] for c, v in got.items()}


def test_each_assistant_turn_is_an_example(frame):
    df, rows = conversations(frame)
    formatted = chat_format.format_turns(df)
    stream = {}
    for r in sorted(formatted.collect(), key=lambda r: r["at"]):
        stream[r["conv_id"]] = stream.get(r["conv_id"], "") + r["piece"]
    spans = chat_format.examples(formatted).collect()
    assert len(spans) == sum(r[2] == "assistant" for r in rows)
    texts = {(r["conv_id"], r["target_turn"]): (r["context"], r["target"]) for r in chat_format.render(formatted).collect()}
    for s in spans:
        whole = stream[s["conv_id"]]
        assert texts[s["conv_id"], s["target_turn"]] == (whole[: s["context_stop"]], whole[s["context_stop"] : s["stop"]])
        turns = [r for r in in_order(rows) if r[0] == s["conv_id"]]
        assert chat_format.unescape(whole[s["loss_start"] : s["loss_stop"]]) == turns[s["target_turn"]][3]


def test_the_loss_is_that_of_the_examples(frame):
    df, rows = conversations(frame)
    formatted = chat_format.format_turns(df)
    targets = chat_format.examples(formatted)
    loss = lambda found: {r["conv_id"]: r["loss_chars"] for r in chat_format.digests(formatted, found).collect()}
    want = {c: sum(len(x or "") for d, _, r, x, _ in rows if (c, "assistant") == (d, r)) for c in {r[0] for r in rows}}
    assert loss(targets) == want
    assert loss(targets.limit(0)) == dict.fromkeys(want, 0)
    assert loss(targets.where("not (conv_id = 40 and target_turn = 1)")) == want | {40: want[40] - 1000}


def test_no_control_string_survives_in_a_text(frame):
    df, _ = conversations(frame)
    for r in chat_format.format_turns(df).collect():
        body = r["piece"][len("[INST] ") : -len(" [/INST]")] if not r["trainable"] else r["piece"][1 : -len(" </s>")]
        assert not chat_format.re.search(r"(?<!\\)(</?s>|\[/?INST\])", body)


@given(st.text(alphabet="\\<>/s[]INT ", max_size=30))
@settings(max_examples=200, deadline=None)
def test_escapes_reverse(text):
    escaped = chat_format.re.sub(r"(\\*)(</?s>|\[/?INST\])", r"\\\1\2", text)
    assert chat_format.unescape(escaped) == text


def test_no_conversations(frame):
    assert chat_format.digests(chat_format.format_turns(frame([], CHAT))).count() == 0


# --------------------------------------------------------------------- tokens


def library(pieces, unknown, byte_fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.Unigram(pieces, unknown, byte_fallback))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return tokenizer


TEXTS = ["", None, " ", "  a  b ", "Hello world", "▁x ▁", "naïve 😀😀 日本語テキスト", "\n\n\tx", "a" * 3000, "Eauouon.\nEnpaeux leaux", "\x00\x01", "x" * 70 + " " + "x" * 70, "　全角"]


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.read_vocabulary()


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_counts_equal_the_library(frame, vocabulary, byte_fallback):
    draw = random.Random(4)
    texts = TEXTS + ["".join(draw.choice("the in re on ▁étß😀\n.") for _ in range(draw.randint(1, 80))) for _ in range(100)]
    tokenizer = library(*vocabulary, byte_fallback)
    docs = frame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    got = {r["row"]["doc_id"]: (r["n_chars"], r["n_tokens"]) for r in token_counts.count_tokens(docs, byte_fallback=byte_fallback).collect()}
    assert got == {i: (len(t or ""), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


@given(
    st.dictionaries(st.text(alphabet="ab▁é", min_size=1, max_size=4), st.integers(-6, 0), min_size=1, max_size=12),
    st.lists(st.text(alphabet="abcé ", max_size=14), max_size=6),
)
@settings(max_examples=150, deadline=None)
def test_ties_are_broken_as_in_the_library(scores, texts):
    pieces = [("<unk>", 0.0), *((p, float(s)) for p, s in scores.items())]
    counter, tokenizer = token_counts.Counter(pieces, 0, False), library(pieces, 0, False)
    for text in texts:
        assert counter.text(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_a_vocabulary_over_the_bound_is_an_error(frame):
    with pytest.raises(ValueError, match="over the bound"):
        token_counts.count_tokens(frame([("a",)], "text string"), max_pieces=100)


@pytest.mark.parametrize("kind", ["smallint", "decimal(10,0)", "double", "string", "int"])
def test_digests_keep_the_type_of_ids(spark, kind):
    turns = spark.createDataFrame([(5, 0, "user", "a"), (5, 1, "assistant", "b"), (None, 0, "user", "c")], "conv_id long, turn int, role string, text string")
    typed = turns.withColumn("conv_id", turns["conv_id"].cast(kind))
    found = chat_format.digests(chat_format.format_turns(typed))
    assert found.schema["conv_id"].dataType.simpleString() == kind
    assert sorted((r["conv_id"] is None, r["n_turns"], r["loss_chars"]) for r in found.collect()) == [(False, 2, 1), (True, 1, 0)]
