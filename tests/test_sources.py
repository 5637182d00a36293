"""Readers over files written in the test."""

from __future__ import annotations

import json
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from motorwatch.functions.text import html_to_text
from motorwatch.operators import worklist
from motorwatch.querybook import lifecycle
from motorwatch.sources import archives, documents, evalsets, feeds
from motorwatch.sources.flat_files import read_csv_snapshots, read_flat
from motorwatch.sources.taxonomy import Taxonomy, resolve_make


def test_layouts_have_the_published_widths():
    assert [len(c) for c in (feeds.RECALLS, feeds.COMPLAINTS, feeds.INVESTIGATIONS, feeds.BULLETINS)] == [29, 49, 11, 14]
    assert feeds.FEEDS["bronze_recalls"].schema().names[-4:] == feeds.PROVENANCE.names


def test_flat_rows_pad_skip_and_overflow(spark, tmp_path):
    path = tmp_path / "rows.txt"
    lines = [
        "",
        'a\tb\tc\tX\t"Y\tstill ""Y"""\t',
        "\t\t",
        "1\t24V001000",
        '"q\t1"\t\té',
        "",
    ]
    path.write_bytes("\n".join(lines).encode("latin-1"))
    rows = read_flat(spark, str(path), ("one", "two", "three"), overflow=True).collect()
    got = [(r["one"], r["two"], r["three"], r["_overflow"]) for r in rows]
    assert got == [
        ("a", "b", "c", ["X", 'Y\tstill "Y"', ""]),
        ("1", "24V001000", None, None),
        ("q\t1", None, "é", None),
    ]
    narrow = read_flat(spark, str(path), ("one", "two", "three"))
    assert [r["one"] for r in narrow.select("one").collect()] == ["a", "1", "q\t1"]


def test_flat_rows_with_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "multi.txt"
    path.write_text('1\t"two\nlines"\n2\tx\n')
    assert read_flat(spark, str(path), ("a", "b"), multi_line=True).count() == 2


def test_csv_snapshots_union(spark, tmp_path):
    (tmp_path / "ads.csv").write_text('Report ID,Make,"Speed (MPH)?"\n1,Waymo,\n2,"Zoox, Inc",7\n')
    (tmp_path / "adas.csv").write_text("report-id,Weather\n3,Clear\n")
    df = read_csv_snapshots(spark, [str(tmp_path / "ads.csv"), str(tmp_path / "adas.csv")])
    assert df.columns == ["report_id", "make", "speed_mph", "_sgo_source", "weather"]
    got = {r["report_id"]: r for r in df.collect()}
    assert got["2"]["make"] == "Zoox, Inc" and got["1"]["speed_mph"] is None
    assert (got["3"]["weather"], got["3"]["_sgo_source"], got["3"]["make"]) == ("Clear", "adas.csv", None)


def test_headers_that_become_equal_keep_the_last(spark, tmp_path):
    (tmp_path / "twice.csv").write_text("Report ID,Make,Report-ID\n1,A,2\n")
    row = read_csv_snapshots(spark, [str(tmp_path / "twice.csv")]).first()
    assert (row["report_id"], row["make"]) == ("2", "A")


def test_archives_follow_the_size_of_their_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lifecycle, "ARCHIVE_BYTES", 1000)
    path, lines = str(tmp_path / "zips"), [f"{i}\tpart {i}" for i in range(2000)]
    lifecycle._write_archives(spark.createDataFrame([(x,) for x in lines], "line string"), path, "FLAT_TSBS.txt")
    read = archives.read_zip_lines(spark, path, "flat_tsb").collect()
    assert sorted(r["line"] for r in read) == sorted(lines)
    held = Counter(r["archive"] for r in read)
    assert len(held) == -(-sum(len(x) + 2 for x in lines) // 1000) and max(held.values()) <= 2 * 2000 / len(held)
    lifecycle._write_archives(spark.createDataFrame([], "line string"), path + "0", "FLAT_TSBS.txt")
    assert archives.read_zip_lines(spark, path + "0", "flat_tsb").count() == 0


def test_zip_members_stream_as_lines(spark, tmp_path):
    for name, member in (("TSBS_RECEIVED_2020-2024.zip", "tsbs_received_2020.txt"), ("MFR_COMMS_RECEIVED_2025.zip", "mfr_comms.csv")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("readme.md", "no")
            z.writestr(member, "\n".join(f"{name[:3]}{i}\té\t" for i in range(50)).encode("latin-1") + b"\r\n\n")
    lines = archives.read_zip_lines(spark, str(tmp_path), lines_per_batch=7)
    rows = archives.parse_lines(lines, ("id", "text", "none", "absent")).collect()
    assert len(rows) == 100 and {r["text"] for r in rows} == {"é"} and {r["none"] for r in rows} == {None}
    assert archives.member_for("FLAT_TSBS.zip") == "FLAT_TSB"
    with pytest.raises(Exception, match="no member like"):
        archives.read_zip_lines(spark, str(tmp_path), "FLAT_CMPL").collect()


def test_fields_past_the_known_columns_survive(spark):
    lines = spark.createDataFrame([('1\ta\tb\textra1\t"ex ""t\t2"',), ("2\ta",), ("\t\t\tonly",), ("\t",), ("",)], "line string")
    rows = archives.parse_lines(lines, ("x", "y", "z")).collect()
    assert [tuple(r) for r in rows] == [("1", "a", "b", ["extra1", 'ex "t\t2']), ("2", "a", None, None), (None, None, None, ["only"])]
    assert archives.parse_lines(lines, ("x", "y", "z"), overflow=False).columns == ["x", "y", "z"]


def test_links_of_any_depth_resolve(spark):
    from motorwatch.functions.payloads import resolve_url

    deep = "/".join(f"d{i}" for i in range(50))
    cases = {
        "../" * 40 + "x.pdf": "http://h/" + "/".join(f"d{i}" for i in range(10)) + "/x.pdf",
        "../" * 90 + "x.pdf": "http://h/x.pdf",
        "./a/./b/../c.pdf?p=../q#/../r": f"http://h/{deep}/a/c.pdf?p=../q#/../r",
        "/a/b/..": "http://h/a/",
        "/a/.hidden/..b/c.pdf": "http://h/a/.hidden/..b/c.pdf",
    }
    df = spark.createDataFrame([(f"http://h/{deep}/page", k) for k in cases], "base string, link string")
    got = {r["link"]: r["u"] for r in df.select("link", resolve_url(F.col("base"), F.col("link")).alias("u")).collect()}
    assert got == cases


def test_a_case_that_does_not_fit_waits(spark):
    entries = spark.createDataFrame([(c, p, f"http://h/{c}/{p}") for c, n in (("A", 2), ("B", 3), ("C", 1)) for p in range(n)], "nhtsa_action_number string, pos int, url string")
    entries = entries.withColumn("title", F.lit(None).cast("string"))
    cases = entries.select("nhtsa_action_number", F.lit("20200101").alias("opened")).distinct()
    done, runs = spark.createDataFrame([], "nhtsa_action_number string"), []
    for _ in range(4):
        todo = worklist.unscraped(cases, done, "nhtsa_action_number", "opened", "20000101")
        rows = documents.document_rows(entries.join(todo, "nhtsa_action_number", "left_semi"), "/d", max_docs=2)
        runs.append(sorted(r["document_url"] for r in rows.collect()))
        done = done.union(spark.createDataFrame([(u.split("/")[3],) for u in runs[-1]], "nhtsa_action_number string"))
    assert [len(r) for r in runs] == [2, 3, 1, 0]


def test_only_wanted_files_are_read(spark, tmp_path, plan):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.bin").write_bytes(name.encode() * 3)
    wanted = spark.createDataFrame([("1", f"{tmp_path}/a.bin"), ("2", f"file:{tmp_path}/c.bin"), ("3", f"{tmp_path}/none.bin")], "doc_id string, volume_path string")
    loaded = documents.load_binaries(spark, wanted, str(tmp_path))
    assert {r["doc_id"]: r["content"] and bytes(r["content"]) for r in loaded.collect()} == {"1": b"aaa", "2": b"ccc", "3": None}
    scan = next(line for line in plan(loaded).splitlines() if "binaryFile" in line)
    assert "ReadSchema: struct<path:string>" in scan


def test_documents_are_opened_by_all_cores(spark, tmp_path):
    for name in range(40):
        (tmp_path / f"{name}.bin").write_bytes(str(name).encode() * 3)
    (tmp_path / "with space.bin").write_bytes(b"spaced")
    paths = [f"{tmp_path}/{name}.bin" for name in [*range(41), "with space"]]
    wanted = spark.createDataFrame([(str(i), p) for i, p in enumerate(paths)], "doc_id string, volume_path string").orderBy("doc_id").limit(50)
    want = {str(i): str(i).encode() * 3 for i in range(40)} | {"40": None, "41": b"spaced"}
    for files in (None, documents.list_files(spark, str(tmp_path))):
        loaded = documents.load_binaries(spark, wanted, str(tmp_path), files=files)
        assert {r["doc_id"]: r["content"] and bytes(r["content"]) for r in loaded.collect()} == want
        tasks = loaded.select(F.spark_partition_id().alias("task")).distinct().count()
        assert tasks > 4


def test_stored_lines_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lifecycle, "FOLDER_FILES", 3)
    rows = [(str(i), f"line {i}") for i in range(10)] + [("3", "line 3"), (None, "no id"), ("x", None)]
    lines = spark.createDataFrame(rows, "doc_id string, line string").coalesce(1)
    kept = [(r["doc_id"], r["volume_path"]) for r in lifecycle._write_files(lines, f"{tmp_path}/files").collect()]
    assert sorted(d for d, _ in kept) == sorted(["", "x", *map(str, range(10))])
    text = {d: open(p).read() for d, p in kept}
    assert text["3"] == "line 3\nline 3\n" and text[""] == "no id\n" and text["x"] == "\n" and text["9"] == "line 9\n"
    assert len({p.rsplit("/", 1)[0] for _, p in kept}) == 4
    assert lifecycle._write_files(lines.limit(0), f"{tmp_path}/none").count() == 0 and (tmp_path / "none").is_dir()


def test_questions_are_checked(spark, tmp_path):
    good = tmp_path / "t1.tsv"
    good.write_text("# note\n\t \nquestion\treference_sql\texpected_value\nHow many?\tSELECT 1\t1\n  # more\nWhy?\t\tTBD:x\n")
    rows = evalsets.read_questions(spark, str(good), "tier1").orderBy("question").collect()
    assert [(r["tier"], r["question"], r["expected_value"]) for r in rows] == [("tier1", "How many?", "1"), ("tier1", "Why?", "TBD:x")]
    bad = {
        "header": "q\ta\nx\ty\n",
        "expected header": "x\ty\nquestion\treference_answer\n",
        "without exactly": "question\treference_answer\nx\n",
        "no questions": "question\treference_answer\n",
    }
    for message, content in bad.items():
        path = tmp_path / f"{message.split()[0]}.tsv"
        path.write_text(content)
        with pytest.raises(ValueError, match=message):
            evalsets.read_questions(spark, str(path), "tier3")
    with pytest.raises(ValueError, match="unknown tier"):
        evalsets.read_questions(spark, str(good), "tier9")


def test_line_list_and_result_files(spark, tmp_path):
    path = tmp_path / "inputs.txt"
    path.write_text("# c\n one \n\ntwo\n")
    assert [r[0] for r in evalsets.read_line_list(spark, str(path)).collect()] == ["one", "two"]
    folder = tmp_path / "per_question"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.json").write_text(json.dumps({"tier": "tier2", "question": f"q{i}", "score": 0.5, "metric_breakdown": {"cite_ok": True, "judge_score": 4}}, indent=1))
    rows = evalsets.read_results(spark, str(folder)).collect()
    assert len(rows) == 3 and rows[0]["metric_breakdown"]["judge_score"] == 4.0


def test_make_resolution(spark):
    samples = {
        "CHEVROLET": ("Chevrolet", "General Motors"),
        "CHEVY": ("Chevrolet", "General Motors"),
        " chevy ": ("Chevrolet", "General Motors"),
        "ZYX-MOTORS": ("Zyx-Motors", None),
        "TESLA": ("Tesla", "Tesla"),
        "tesla": ("tesla", "Tesla"),
        "GMC": ("Gmc", "General Motors"),
        "": (None, None),
        None: (None, None),
    }
    df = spark.createDataFrame([(m,) for m in samples], "m string")
    got = {r["m"]: (r["make_norm"], r["oem_group"]) for r in resolve_make(df, "m").collect()}
    assert got == samples
    own = Taxonomy(groups={"G": ("Aa",)}, aliases={"ALPHA": "Aa"})
    assert tuple(resolve_make(spark.createDataFrame([("alpha",)], "m string"), "m", own).first())[1:] == ("Aa", "G")


def test_documents_and_backlog(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.html").write_text("<p>first</p>")
    (folder / "b.html").write_text("<p></p>")
    names = ("a", "b", "missing")
    docs = spark.createDataFrame([(n, str(folder / f"{n}.html")) for n in names], "document_id string, volume_path string")
    spark.sql("CREATE SCHEMA IF NOT EXISTS w")

    def run(budget):
        return worklist.drain(
            spark,
            docs,
            lambda todo: documents.load_binaries(spark, todo, str(folder)),
            lambda df: html_to_text(F.decode("content", "UTF-8")),
            "w.parsed",
            "w.tracker",
            doc_id="document_id",
            path="volume_path",
            version="html/1",
            budget=budget,
        )

    assert run(2) == {"queued": 2, "parsed_ok": 1, "parsed_err": 1}
    assert run(2) == {"queued": 1, "parsed_ok": 0, "parsed_err": 1}
    assert run(2) == {"queued": 0, "parsed_ok": 0, "parsed_err": 0}
    status = {r["doc_id"]: (r["parse_status"], r["error_message"]) for r in spark.table("w.tracker").collect()}
    assert status == {"a": ("ok", None), "b": ("error", "document has no text"), "missing": ("error", "document is missing")}
    assert spark.table("w.parsed").select("full_text").first()[0] == "first"


def test_listing_falls_back_to_links(spark):
    bodies = spark.createDataFrame(
        [("PE1", '{"documents":[]}', "http://h/x"), ("PE2", '<a href="/d/1.pdf"><a href="/d/1.pdf">', "http://h/x"), ("", '[{"url":"u.pdf"}]', "http://h/x")],
        "nhtsa_action_number string, body string, base string",
    )
    entries = documents.listing_entries(bodies, "body", F.col("base"))
    rows = documents.document_rows(entries, "/docs", max_docs=5).collect()
    assert [(r["nhtsa_action_number"], r["document_url"]) for r in rows] == [("PE2", "http://h/d/1.pdf")]
    assert rows[0]["document_id"].startswith("PE2__") and rows[0]["volume_path"].endswith(rows[0]["file_name"])
