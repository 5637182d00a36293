"""Column expressions on small texts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from motorwatch.functions import casts, payloads, privacy, scoring, text
from motorwatch.functions.calls import textual_call
from motorwatch.functions.vectors import cosine


def test_masking_covers_each_class_and_leaves_the_rest(column):
    cases = {
        "My VIN is 1HGCM82633A123456 ok": "My VIN is [VIN] ok",
        "A" * 17: "A" * 17,
        "call (555) 123-4567 now": "call [PHONE] now",
        "555.123.4567": "[PHONE]",
        "+1 555-123-4567": "[PHONE]",
        "555 123 4567": "[PHONE]",
        "jane.doe+spam@example.co.uk": "[EMAIL]",
        "ref 12345678 end": "ref [NUM] end",
        "at 50000 miles": "at 50000 miles",
        "5551234567": "[NUM]",
        "": "",
        None: None,
    }
    got = column(privacy.mask_personal("x"), list(cases))
    assert [g.replace("([PHONE]", "[PHONE]") if g else g for g in got] == list(cases.values())


def test_masking_tallies(spark):
    df = spark.createDataFrame(
        [("1HGCM82633A123456, 555-123-4567, a@b.org, 123456789",), (None,)], "x string"
    ).select(*[c.alias(n) for n, c in privacy.mask_tallies("x").items()])
    assert [tuple(r) for r in df.collect()] == [(1, 1, 1, 1), (0, 0, 0, 0)]


def test_title_case_matches_python_on_ascii(column):
    samples = ["ZYX-MOTORS", "land rover", "O'NEIL (USA)/x", "a1b2", "", "ABC  DEF"]
    assert column(text.title_case("x"), samples) == [s.title() for s in samples]


def test_strip_matches_python(column):
    samples = [" a ", "\t\n\x0b\x0c\r a\x1c\x1d\x1e\x1f", "  b　 ", "​kept​", "   "]
    assert column(text.strip(F.col("x")), samples) == [s.strip() for s in samples]


def test_word_count_matches_python(column):
    samples = ["", "  ", "one", "a b c", "x\x1cy\tz\n", "word " * 400, None]
    assert column(text.word_count("x"), samples) == [len((s or "").split()) for s in samples]
    under = column(scoring.word_count_under("x"), ["w " * 400, "w " * 401, ""])
    assert under == [True, False, True]


def test_component_path(column):
    samples = ["ENGINE AND ENGINE COOLING:ENGINE:CYLINDER BLOCK", "BATTERY", "Air bags: Side", None]
    assert column(text.component_group("x"), samples) == ["Engine And Engine Cooling", "Battery", "Air bags", None]
    assert column(text.component_leaf("x"), samples) == ["Cylinder Block", "Battery", "Side", None]


@pytest.mark.parametrize(
    ("raw", "name"),
    [("Report ID", "report_id"), ("Posted Speed (MPH)?", "posted_speed_mph"), ("__a__b--C", "a_b_c"), ("ÜX", "x")],
)
def test_header_names(column, raw, name):
    assert text.header_name(raw) == name
    assert column(text.header_name_col("x"), [raw]) == [name]


def test_dates_are_clamped(column):
    samples = ["", None, "00000000", "00031020", "22030726", "20240229", "20230229", "19491231", "20250601"]
    as_of = F.lit("2024-06-01").cast("date")
    want = [None] * 5 + [dt.date(2024, 2, 29), None, None, dt.date(2025, 6, 1)]
    assert column(casts.compact_date("x", as_of), samples) == want


def test_texts_of_another_shape_never_reach_a_parser(spark, column, plan):
    samples = ["20200131", "20200230", "20201301", "20200100", "2020131", "020200131", "20200131 ", "20200131\n", "+20200131", "-20200131", "٢٠٢٠٠١٣١"]
    as_of = F.lit("2024-06-01").cast("date")
    assert column(casts.compact_date("x", as_of), samples) == [dt.date(2020, 1, 31)] + [None] * 10
    numbers = ["+5", "-5", "\t5\n", "5\x7f", "+", "", "5.0", "1e3", "５", "2147483648", " - 5"]
    assert column(casts.lenient_int("x"), numbers) == [5, -5, 5, 5] + [None] * 7
    assert column(casts.lenient_long("x"), numbers)[9] == 2147483648
    assert column(casts.any_date("x"), ["05/32/2024", "2024-13-01", "XYZ-2024", "unknown", "2024"]) == [None] * 4 + [dt.date(2024, 1, 1)]
    df = spark.createDataFrame([("x",)], "x string")
    for made in (casts.compact_date("x", as_of), casts.lenient_int("x"), casts.any_date("x")):
        assert "RLIKE" in plan(df.repartition(1).select(made)).upper()


def test_crash_dates_and_levels(column):
    samples = ["2024-05-01", "05/01/2024", "MAR-2026", "Mar-2026", "junk", None]
    want = [dt.date(2024, 5, 1), dt.date(2024, 5, 1), dt.date(2026, 3, 1), dt.date(2026, 3, 1), None, None]
    assert column(casts.any_date("x"), samples) == want
    assert column(casts.automation_level("x"), ["Level 4", "L3", "SAE 2", "none", None]) == ["L4", "L3", "L2", "L", None]


def test_lenient_numbers_and_flags(column):
    samples = ["7", " 7 ", "", "12.0", "x", None, "99999999999"]
    assert column(casts.lenient_int("x"), samples) == [7, 7, None, None, None, None, None]
    assert column(casts.lenient_long("x"), samples)[-1] == 99999999999
    assert column(casts.yes_flag("x"), ["Y", "y", "N", "", None]) == [True, True, False, False, False]


def test_exact_score(spark):
    cases = [
        ("42", "There were 42 campaigns", 1.0),
        ("42", "In 2024 there were 42", 0.0),
        ("42.0", "42", 1.0),
        ("Ford|General Motors|Tesla|Kia|BMW", "ford, general motors, TESLA and kia", 1.0),
        ("Ford|Tesla|Kia", "only ford", 0.0),
        ("|", "anything", 0.0),
        ("model year 2023", "It was Model Year 2023.", 1.0),
        ("", "anything", 0.0),
        (None, None, 0.0),
    ]
    df = spark.createDataFrame(cases, "e string, a string, want double")
    assert [r for r in df.withColumn("got", scoring.score_exact("e", "a")).collect() if r["got"] != r["want"]] == []


def test_citations(spark, column):
    present = ["23V123456", "22V-123-456", "PE22-001", "TSB 10160095", "ODI ID 11512345", "see 11512345"]
    absent = ["42 campaigns in 2023", "1234567", "", None]
    assert column(scoring.cite_id_present("x"), present + absent) == [True] * 6 + [False] * 4
    cases = [
        ("TSB-10160095", "per TSB 10160095", True),
        ("ODI-11512345", "ODI ID 11512345 says", True),
        ("23V-085", "23V085 it is", True),
        ("23V-085", "23085", False),
        ("", "x", False),
        (None, "x", False),
    ]
    df = spark.createDataFrame(cases, "s string, a string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", scoring.cite_match("s", "a")).collect())


def test_grounded_and_rubric_scores(spark):
    df = spark.createDataFrame([("A1", "a1", 4.0), ("A1", "a1", 3.9), ("A1", "no", 5.0), ("A1", "a1", None)], "s string, a string, j double")
    got = df.select(scoring.score_grounded("s", "a", F.col("j")), scoring.score_grounded("s", "a")).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0), (0.0, 1.0), (0.0, 0.0), (0.0, 1.0)]
    parts = spark.createDataFrame([(5, 4, 3, 4, 4, 1.0), (0, 0, 0, 0, 0, 3.5), (None, 0, 0, 0, 0, None)], "a int, b int, c int, d int, e int, o double")
    score = scoring.score_rubric([F.col(c) for c in "abcde"], F.col("o"))
    assert [tuple(r) for r in parts.select(score, scoring.rubric_passed(score)).collect()] == [(4.0, True), (3.5, True), (0.0, False)]


def test_keywords_are_substrings(column):
    assert column(scoring.mentions_any("x"), ["a TESLA", "the frame", "nothing", None]) == [True, True, False, False]


def test_triage(spark):
    cases = [
        (False, None, "TSB-10160095", "no 10160095", "A"),
        (False, None, "TSB-10160095", "nothing", "B"),
        (True, 3.0, "x", "x", "C"),
        (True, None, "x", "x", "D"),
        (True, 4.5, "x", "x", "other"),
    ]
    df = spark.createDataFrame(cases, "ok boolean, j double, s string, a string, want string")
    got = df.withColumn("got", scoring.triage_bucket(F.col("ok"), F.col("j"), "s", "a")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_textual_calls(column):
    names = ("fetch_tsb", "genie_recalls")
    samples = [
        'fetch_tsb(nhtsa_item_number="10")',
        "  genie_recalls ( {\"question\": \"a (b)\", \"n\": 2} ) ",
        "fetch_tsb(id='a', id=\"b\", other='')",
        'unknown(id="1")',
        "fetch_tsb(10)",
        "I called fetch_tsb(id=\"1\") already",
        'fetch_tsb(id="multi\nline")',
        "",
        None,
    ]
    got = column(textual_call("x", names), samples)
    assert [g and (g["name"], g["args"]) for g in got] == [
        ("fetch_tsb", {"nhtsa_item_number": "10"}),
        ("genie_recalls", {"question": "a (b)", "n": "2"}),
        ("fetch_tsb", {"id": "b", "other": ""}),
        None,
        None,
        None,
        ("fetch_tsb", {"id": "multi\nline"}),
        None,
        None,
    ]


def test_listed_documents(column):
    samples = [
        '{"results":[{"investigations":[{"associatedDocuments":[{"url":"u1","summary":"s"},{"url":"u2","fileName":"f"},{"summary":"x"}]}]}]}',
        '{"results":[{"url":"u","title":"t"}]}',
        '{"documents":{"no":"list"},"data":[{"documentURL":"a"},{"documentUrl":"b","name":"n"}]}',
        '[{"href":"h"}]',
        '{"other":1}',
        "<html>",
    ]
    got = column(payloads.listed_documents("x"), samples)
    assert [g and [tuple(e) for e in g] for g in got] == [
        [("u1", "s"), ("u2", "f")],
        [("u", "t")],
        [("a", None), ("b", "n")],
        [("h", None)],
        [],
        None,
    ]


def test_links_resolve_like_urljoin(spark):
    from urllib.parse import urljoin

    base = "https://a.example/x/y/page.html?q=1#top"
    links = ["z.pdf", "/r.pdf", "//b.example/c.pdf", "http://c.example/d.pdf", "../up.pdf", "./same.pdf", "../../../far.pdf", "#frag", "sub/./k/../m.pdf"]
    df = spark.createDataFrame([(x,) for x in links], "x string")
    got = [r[0] for r in df.select(payloads.resolve_url(F.lit(base), F.col("x"))).collect()]
    assert got == [urljoin(base, x) for x in links]


def test_page_links_keep_first_of_each(column):
    page = '<a HREF="a.pdf">1</a><a href="b.PDF"><a href="a.pdf"><a href="c.html">'
    assert column(payloads.page_links("x", F.lit("http://h/d/p")), [page]) == [["http://h/d/a.pdf", "http://h/d/b.PDF"]]


def test_document_text(column):
    samples = [
        '{"document":{"elements":[{"type":"text","content":"a"},{"type":"page_footer","content":"f"},{"type":"figure","content":"","description":"d"},{"content":"untyped"},{"type":"text"}]}}',
        '{"document":{"elements":[]},"text":"plain"}',
        '{"other":1}',
    ]
    assert column(payloads.document_text("x"), samples) == ["a\nd", "plain", '{"other":1}']


def test_truncation_marker(column):
    short, long = "x" * 8000, "y" * 8005
    got = column(text.truncate_with_marker("x"), [short, long])
    assert got[0] == short
    assert got[1].startswith("y" * 8000 + "... [TRUNCATED 5 chars")


def test_html_to_text(column):
    page = "<title>T &amp; x</title><script>var a='<p>';</script><!-- no --><p>one</p>\n<p>two&nbsp;3</p>"
    assert column(text.html_to_text("x"), [page]) == ["T & x one two 3"]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert df.select(cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(2**-0.5)


def test_a_call_is_read_once(spark, plan):
    from motorwatch.functions.calls import textual_call

    text = plan(spark.createDataFrame([("f(a='1')",)], "x string").select(textual_call("x", ("f",))))
    assert text.count("regexp_extract_all") <= 4 and text.count("from_json") <= 2
