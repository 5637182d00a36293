"""Quoted line breaks in files of many splits, against Python's csv module."""

from __future__ import annotations

import csv
import io
import random
import zipfile

import pytest
from motorwatch.sources import archives, records
from motorwatch.sources.flat_files import read_csv_snapshots, read_flat

COLUMNS = ("a", "b", "c")


@pytest.fixture
def splits(spark):
    """Makes files split every few bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def every(size: int) -> None:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield every
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def random_file(seed: int, sep: str, rows: int) -> str:
    draw = random.Random(seed)
    fields = ["", "x", '15" wheel', 'a "quoted" word', "é", "plain text", '5""']
    quoted = ['""', '"two\nlines"', '"a ""b"" c"', f'"{sep}"', '"\n\n\n"', f'"x{sep}\n""y"""', '"cr\r\nlf"', f'"{"long " * 30}\n"']
    lines = []
    for _ in range(rows):
        n = draw.choice([1, 2, 3, 3, 3])
        lines.append(sep.join(draw.choice(fields + quoted) for _ in range(n)))
    return "".join(line + draw.choice(["\n", "\r\n"]) for line in lines)


def expected(text: str, sep: str) -> list[tuple]:
    rows = []
    for row in csv.reader(io.StringIO(text, newline=""), delimiter=sep, quotechar='"'):
        if any(row):
            rows.append(tuple((*row, None, None, None)[:3]))
    return sorted(rows, key=repr)


def plain(rows) -> list[tuple]:
    """NULL and empty are one here: the reader gives NULL where a field holds nothing."""
    return sorted((tuple(v or None for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_records_equal_the_csv_module(spark, tmp_path, splits, size):
    texts = [random_file(seed, "\t", 30) for seed in range(2)]
    for i, text in enumerate(texts):
        (tmp_path / f"f{i}.txt").write_bytes(text.encode("latin-1"))
    splits(size)
    df = read_flat(spark, str(tmp_path), COLUMNS)
    want = plain(r for t in texts for r in expected(t, "\t"))
    assert plain(df.collect()) == want
    tasks = records._lines(spark, str(tmp_path)).rdd.getNumPartitions()
    assert tasks > (10 if size < 100 else 0)


def test_states_beyond_the_broadcast_bound(spark, tmp_path, splits):
    text = random_file(9, "\t", 20)
    (tmp_path / "f.txt").write_bytes(text.encode("latin-1"))
    splits(80)
    few, many = (records.read_records(spark, str(tmp_path), "\t", "ISO-8859-1", most_open=n) for n in (100_000, 0))
    assert sorted(r["record"] for r in few.collect()) == sorted(r["record"] for r in many.collect())
    assert sum(r["first"] for r in few.collect()) == 1


def test_line_function():
    draw = random.Random(4)
    for _ in range(500):
        text = "".join(draw.choice(['"', '""', "\t", "x", "\t\"", "\n"]) for _ in range(draw.randint(0, 14)))
        inside = False
        for line in text.split("\n"):
            inside = records.ends_inside(line.encode(), inside, b"\t")
        # A file that ends inside quotes takes up a row that follows, any other does not.
        rows = list(csv.reader(io.StringIO(text + "\nend", newline=""), delimiter="\t"))
        assert inside == (rows[-1] != ["end"]), repr(text)


def test_a_quote_that_is_never_closed(spark, tmp_path, splits, monkeypatch):
    (tmp_path / "f.txt").write_text('1\t"open\n' + "line\n" * 200)
    splits(64)
    rows = read_flat(spark, str(tmp_path), ("a", "b")).collect()
    assert len(rows) == 1 and rows[0]["b"].count("line") == 200
    monkeypatch.setattr(records, "LONGEST_RECORD", 500)
    with pytest.raises(Exception, match="is a quote not closed"):
        read_flat(spark, str(tmp_path), ("a", "b")).collect()


def test_files_without_breaks_take_the_plain_reader(spark, tmp_path, plan):
    (tmp_path / "f.txt").write_text('1\t"a ""b"" c"\n2\t15" wheel\n')
    df = read_flat(spark, str(tmp_path), ("a", "b"))
    assert "Scan csv" in plan(df) and "Python" not in plan(df)
    assert plain(df.collect()) == [("1", 'a "b" c'), ("2", '15" wheel')]


def test_other_encodings(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes('1\t"é\nß"\n2\tx\n'.encode("UTF-16"))
    assert plain(read_flat(spark, str(tmp_path), ("a", "b"), encoding="UTF-16").collect()) == [("1", "é\nß"), ("2", "x")]


def test_snapshots_with_breaks(spark, tmp_path, splits):
    (tmp_path / "one.csv").write_text('Report ID,"Narrative\n(text)"\n1,"line one\nline two"\n2,"a, ""b"""\n')
    (tmp_path / "two.csv").write_text('Report ID,"Narrative\n(text)"\n3,\n')
    (tmp_path / "three.csv").write_text("Report ID,City\n4,Ürzig\n")
    splits(50)
    df = read_csv_snapshots(spark, [str(tmp_path / f"{n}.csv") for n in ("three", "one", "two")])
    assert df.columns == ["report_id", "city", "_sgo_source", "narrative_text"]
    assert plain(df.select("report_id", "narrative_text", "city", "_sgo_source").collect()) == [
        ("1", "line one\nline two", None, "one.csv"), ("2", 'a, "b"', None, "one.csv"), ("3", None, None, "two.csv"), ("4", None, "Ürzig", "three.csv"),
    ]


def test_snapshots_with_equal_headers_are_one_scan(spark, tmp_path, plan):
    for i in range(9):
        (tmp_path / f"{i}.csv").write_text(f"Report ID,City\n{i},x\n")
    df = read_csv_snapshots(spark, [str(tmp_path)])
    assert plan(df).count("Scan csv") == 1 and "Union" not in plan(df)
    assert sorted(r["report_id"] for r in df.collect()) == [str(i) for i in range(9)]


def test_zip_records_with_breaks(spark, tmp_path):
    texts = [random_file(seed, "\t", 40) for seed in (21, 22)]
    for i, text in enumerate(texts):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("FLAT_TSBS.txt", text.encode("latin-1"))
    df = archives.read_zip_lines(spark, str(tmp_path), "flat_tsb", lines_per_batch=7)
    assert plain(archives.parse_lines(df, COLUMNS, overflow=False).collect()) == plain(r for t in texts for r in expected(t, "\t"))
    assert {r["archive"].rsplit("/", 1)[-1] for r in df.collect()} == {"0.zip", "1.zip"}


@pytest.mark.parametrize("piece", [1, 3, 1000])
def test_members_are_read_in_pieces(piece):
    class Raw:
        """Keeps the largest read asked for."""

        def __init__(self, data: bytes):
            self.data, self.most = io.BytesIO(data), 0

        def read(self, n: int = -1) -> bytes:
            assert n > 0, "the member is never read whole"
            self.most = max(self.most, n)
            return self.data.read(n)

    raw = Raw(b"one\ntwo\r\n\nthree")
    assert list(archives.inflated_lines(raw, piece)) == [b"one\n", b"two\r\n", b"\n", b"three"]
    assert raw.most == piece
    assert list(archives.inflated_lines(Raw(b""), piece)) == []


def test_archives_are_planned_one_partition_each(spark, tmp_path):
    for i in range(5):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as z:
            z.writestr("FLAT_TSBS.txt", f"{i}\tx\n")
    reader = archives.ZipReader({"archives": '["a.zip", "b.zip"]'})
    assert [p.path for p in reader.partitions()] == ["a.zip", "b.zip"]
    rows = archives.read_zip_lines(spark, f"{tmp_path}/[0-2].zip", "flat").collect()
    assert sorted(r["line"] for r in rows) == ["0\tx", "1\tx", "2\tx"]
