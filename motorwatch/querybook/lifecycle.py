"""Files and tables written, read back and maintained: archives, question files, backlogs, the catalog."""

from __future__ import annotations

import io
import itertools
import uuid
import zipfile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, merge, worklist
from ..plans import corpus, typed
from ..plans.comments import COLUMN_COMMENTS, TABLE_COMMENTS
from ..plans.warehouse import EXPOSED, Warehouse
from ..session import scratch_path, stage
from ..sources import archives, documents, evalsets
from ..sources.feeds import FEEDS
from . import feeds, sqltext
from .registry import Tables, query

# ------------------------------------------------------------------- archives


#: Text in an archive, about.
ARCHIVE_BYTES = 16 << 20


def _write_archives(lines: DataFrame, path: str, member: str, least: int = 4) -> None:
    """One ZIP archive per task, as many as the text's size asks for. Spark's text writer stores the bytes; readers pass over the line break it adds."""
    size = lines.agg(F.sum(F.octet_length(lines.columns[0]) + 2)).first()[0] or 0
    parts = max(least, -(-size // ARCHIVE_BYTES))

    def pack(batches):
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("readme.md", "no data")
            with archive.open(member, "w") as out:
                for batch in batches:
                    out.write("".join(f"{line}\r\n" for line in batch.column(0).to_pylist()).encode("latin-1"))
        yield pa.RecordBatch.from_arrays([pa.array([packed.getvalue()], pa.binary())], names=["z"])

    zipped = lines.repartition(parts).mapInArrow(pack, "z binary")
    zipped.select(F.col("z").cast("string").alias("value")).write.text(path)


_SUPPLIER_LINE = "concat_ws('\t', s_suppkey, s_name, s_nationkey, s_acctbal, s_comment)"
_PART_LINE = "concat_ws('\t', p_partkey, concat('\"', p_name, '\"'), p_brand, p_type, p_size)"


@query("scan_zip_feed", "SELECT p_partkey, p_name, p_brand, p_type, p_size::INTEGER AS p_size FROM part")
def scan_zip_feed(t: Tables):
    """A feed in several archives of one folder, read back whole."""
    path = scratch_path(t.spark, "zips")
    _write_archives(t.part.select(F.expr(_PART_LINE).alias("line")), path, "FLAT_TSBS.txt")
    rows = archives.parse_lines(archives.read_zip_lines(t.spark, path, "flat_tsb"), ("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    return rows.drop("_overflow").withColumns({"p_partkey": F.col("p_partkey").cast("bigint"), "p_size": F.col("p_size").cast("int")})


@query("scan_zip_overflow", "SELECT p_partkey, p_name, p_brand || '|' || p_type || '|' || p_size AS extra FROM part")
def scan_zip_overflow(t: Tables):
    """Two columns are known; the other fields arrive in the overflow and none is lost."""
    path = scratch_path(t.spark, "zips")
    _write_archives(t.part.select(F.expr(_PART_LINE).alias("line")), path, "FLAT_TSBS.txt")
    rows = archives.parse_lines(archives.read_zip_lines(t.spark, path, "flat_tsb"), ("p_partkey", "p_name"))
    return rows.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", F.array_join("_overflow", "|").alias("extra"))


@query(
    "scan_zip_narratives",
    r"""WITH d AS (SELECT doc_id, lang, regexp_replace(text, '[^\x00-\x{FF}]', '?', 'g') AS t FROM documents)
        SELECT doc_id, lang, md5(t) AS body, length(t) - length(replace(t, chr(10), '')) AS n_breaks FROM d""",
)
def scan_zip_narratives(t: Tables):
    """Narratives with line breaks inside quotes, in several archives: each comes back as the one field it was."""
    path = scratch_path(t.spark, "zips")
    text = F.regexp_replace("text", "[^\\x00-\\xFF]", "?")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    _write_archives(t.documents.select(F.concat_ws("\t", "doc_id", quoted, "lang").alias("line")), path, "FLAT_TSBS.txt")
    rows = archives.parse_lines(archives.read_zip_lines(t.spark, path, "flat_tsb"), ("doc_id", "text", "lang"), overflow=False)
    return rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.md5("text").alias("body"),
        F.regexp_count("text", F.lit("\n")).cast("bigint").alias("n_breaks"),
    )


# ------------------------------------------------------------ questions, results

_CLEAN = "regexp_replace(text, '[\t\n\r]+', ' '{g})"


@query("eval_questions", f"SELECT 'tier2' AS tier, trim({_CLEAN.format(g=chr(44) + chr(32) + chr(39) + 'g' + chr(39))}) AS question, 'SB-' || item_id AS source_id, 'claim ' || item_id AS expected_claim FROM benchmark")
def eval_questions(t: Tables):
    """A question file written from the benchmark and read back with all its checks."""
    path = scratch_path(t.spark, "questions")
    rows = t.benchmark.select(
        F.expr(_CLEAN.format(g="")).alias("question"), F.expr("concat('SB-', item_id)").alias("source_id"),
        F.expr("concat('claim ', item_id)").alias("expected_claim"),
    )
    rows.write.csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")
    return evalsets.read_questions(t.spark, path, "tier2")


@query("line_list", "SELECT DISTINCT trim(source) AS question FROM documents")
def line_list(t: Tables):
    """A list with comments and blanks, one entry per source."""
    path = scratch_path(t.spark, "lines")
    entry = F.concat(F.lit("  # note\n\n  "), "source", F.lit(" "))
    t.documents.select(entry.alias("value")).distinct().write.text(path)
    return evalsets.read_line_list(t.spark, path)


@query(
    "result_files",
    """SELECT 'tier1' AS tier, 'q' || doc_id AS question, lang AS answer, quality::DOUBLE AS score, quality = 1 AS passed, FALSE AS pending,
         n_chars / 1000.0::DOUBLE AS latency_s, toxic AS n_tool_calls, quality = 1 AS cite_ok FROM labels JOIN documents USING (doc_id)""",
)
def result_files(t: Tables):
    """Per-question results as JSON files."""
    path = scratch_path(t.spark, "results")
    rows = t.labels.join(t.documents, "doc_id").selectExpr(
        "'tier1' AS tier", "concat('q', doc_id) AS question", "lang AS answer", "CAST(quality AS double) AS score", "quality = 1 AS passed", "false AS pending",
        "n_chars / 1000.0D AS latency_s", "toxic AS n_tool_calls", "named_struct('cite_ok', quality = 1) AS metric_breakdown",
    )
    rows.write.json(path)
    read = t.spark.read.schema(evalsets.RESULT_SCHEMA).json(path)
    return read.select("tier", "question", "answer", "score", "passed", "pending", "latency_s", "n_tool_calls", "metric_breakdown.cite_ok")


# -------------------------------------------------------------------- backlog


#: Files in one folder at most.
FOLDER_FILES = 1000


def _write_files(lines: DataFrame, folder: str) -> DataFrame:
    """The lines of each ``doc_id`` of a task in one file: ``doc_id`` (empty if NULL) and ``volume_path``, once the result is written.

    An attempt of a task has folders of its own, so what a lost one leaves behind is not named.
    """
    spark = lines.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    home = root.getFileSystem(spark._jsc.hadoopConfiguration())
    home.mkdirs(root)
    uri = home.makeQualified(root).toString()

    def write(batches):
        system, base = documents.file_system(uri)
        attempt, n = TaskContext.get().taskAttemptId(), 0
        rows = ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()) for batch in batches for i in range(batch.num_rows))
        names, paths = [], []
        for doc_id, same in itertools.groupby(rows, key=lambda row: row[0]):
            place = f"{attempt}-{n // FOLDER_FILES}"
            if n % FOLDER_FILES == 0:
                system.create_dir(f"{base}/{place}")
            with system.open_output_stream(f"{base}/{place}/{n}.txt") as out:
                for _, line in same:
                    out.write(f"{line or ''}\n".encode())
            names.append(doc_id or "")
            paths.append(f"{folder}/{place}/{n}.txt")
            n += 1
            if len(names) == FOLDER_FILES:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(paths, pa.string())], names=["doc_id", "volume_path"])
                names, paths = [], []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(paths, pa.string())], names=["doc_id", "volume_path"])

    return lines.sortWithinPartitions("doc_id").mapInArrow(write, "doc_id string, volume_path string")


@query(
    "drain_backlog",
    """WITH p AS (SELECT page_id::VARCHAR AS doc_id, html FROM pages)
       SELECT doc_id, md5(html) AS body, 'ok' AS parse_status, NULL::VARCHAR AS error_message, length(html)::BIGINT AS pages FROM p
       UNION ALL SELECT '0-gone', NULL, 'error', 'document is missing', NULL""",
)
def drain_backlog(t: Tables):
    """All stored pages, drained in runs of half the backlog, the last of which finds nothing left; one file is not there."""
    folder, schema = scratch_path(t.spark, "files"), _schema(t)
    docs = stage(_write_files(t.pages.select(F.col("page_id").cast("string").alias("doc_id"), F.base64(F.encode("html", "UTF-8")).alias("line")), folder), "files")
    files = stage(documents.list_files(t.spark, folder), "listing")
    docs = docs.union(t.spark.createDataFrame([("0-gone", f"{folder}/gone.txt")], "doc_id string, volume_path string"))
    html = F.decode(F.unbase64(F.decode("content", "UTF-8")), "UTF-8")
    budget = -(-docs.count() // 2)

    def run() -> int:
        return worklist.drain(
            t.spark, docs, lambda wanted: documents.load_binaries(t.spark, wanted, folder, files=files), lambda df: html, f"{schema}.parsed", f"{schema}.tracker",
            doc_id="doc_id", path="volume_path", version="copy/1", budget=budget, details={"pages": F.length("full_text").cast("bigint")},
        )["queued"]

    while run():
        pass
    tracker = t.spark.table(f"{schema}.tracker").select("doc_id", "parse_status", "error_message")
    parsed = t.spark.table(f"{schema}.parsed").select("doc_id", F.md5("full_text").alias("body"), "pages")
    return tracker.join(parsed, "doc_id", "left").select("doc_id", "body", "parse_status", "error_message", "pages")


# -------------------------------------------------------------------- catalog


def _schema(t: Tables) -> str:
    """A catalog schema of this run alone, stored in the shared folder."""
    name = f"run_{uuid.uuid4().hex[:12]}"
    t.spark.sql(f"CREATE SCHEMA {name} LOCATION '{scratch_path(t.spark, 'schema')}'")
    return name


_RAW = {
    "bronze_recalls": feeds.raw_recalls,
    "bronze_complaints": feeds.raw_complaints,
    "bronze_investigations": feeds.raw_investigations,
    "bronze_tsb_index": feeds.raw_bulletins,
    "bronze_sgo_crashes": feeds.raw_crashes,
}


def _ingested(t: Tables) -> Warehouse:
    house = Warehouse(t.spark, _schema(t))
    feeds.write_lines(t, "covered", "supplied")
    for name, raw in _RAW.items():
        merge.ingest(t.spark, FEEDS[name], raw(t), house.schema, "run-1", f"feed://{name}")
    return house


def _ingested_once(t: Tables) -> Warehouse:
    """The feeds taken in, and the joins below them removed: from here on only the raw tables are read."""
    house = _ingested(t)
    feeds.drop_lines(t, "covered", "supplied")
    return house


_INGESTED = f"""{feeds.SQL_RAW_RECALLS}, {feeds.SQL_RAW_COMPLAINTS}, {feeds.SQL_RAW_INVESTIGATIONS}, {feeds.SQL_RAW_BULLETINS}, {feeds.SQL_RAW_CRASHES},
  n AS (SELECT 'bronze_recalls' AS table_name, count(DISTINCT record_id) AS n FROM raw_recalls
    UNION ALL SELECT 'bronze_complaints', count(DISTINCT cmplid) FROM raw_complaints
    UNION ALL SELECT 'bronze_investigations', count(*) FROM (SELECT DISTINCT nhtsa_action_number, maketxt, modeltxt, yeartxt, component_name FROM raw_investigations)
    UNION ALL SELECT 'bronze_tsb_index', count(*) FROM (SELECT DISTINCT nhtsa_item_number, tsb_id, maketxt, modeltxt, yeartxt, component_desc FROM raw_bulletins)
    UNION ALL SELECT 'bronze_sgo_crashes', count(DISTINCT report_id) FROM raw_crashes)"""


@query("feeds_ingested_twice", f"WITH {_INGESTED} SELECT table_name, n AS n_rows, n AS n_stamped, n AS n_keeping_all FROM n")
def feeds_ingested_twice(t: Tables):
    """All five feeds landed twice: tables are made once, keys enter once, the whole row is kept in ``_raw``."""
    house = _ingested(t)
    for name, raw in _RAW.items():
        merge.ingest(t.spark, FEEDS[name], raw(t), house.schema, "run-2", f"feed://{name}")
    counted = [
        house.table(name).agg(
            F.count("*").alias("n_rows"),
            F.count_if(F.col("_ingest_run_id").eqNullSafe("run-1") & (F.col("_source_url") == f"feed://{name}")).alias("n_stamped"),
            F.count_if(F.startswith("_raw", F.lit("{"))).alias("n_keeping_all"),
        ).select(F.lit(name).alias("table_name"), "n_rows", "n_stamped", "n_keeping_all")
        for name in _RAW
    ]
    rows = counted[0]
    for more in counted[1:]:
        rows = rows.union(more)
    return rows


_BUILT = {
    "silver_recalls": "bronze_recalls", "silver_complaints": "bronze_complaints", "silver_investigations": "bronze_investigations",
    "silver_tsbs": "bronze_tsb_index", "silver_sgo_crashes": "bronze_sgo_crashes", "gold_recalls_fact": "bronze_recalls",
    "gold_complaints_fact": "bronze_complaints", "gold_tsbs_fact": "bronze_tsb_index", "gold_investigations_fact": "bronze_investigations",
    "gold_sgo_av_crashes": "bronze_sgo_crashes",
}


@query(
    "warehouse_built",
    f"WITH {_INGESTED}, b(table_name, raw) AS (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{v}{chr(39)})' for k, v in _BUILT.items())})"
    " SELECT b.table_name, n AS n_rows, n AS n_met FROM b JOIN n ON n.table_name = raw",
)
def warehouse_built(t: Tables):
    """Raw to typed to star, built twice as a rebuild must allow; each fact row meets all its dimensions."""
    house = _ingested_once(t)
    for _ in range(2):
        house.build_typed()
        house.build_star()
    keys = {"dim_vehicle": "vehicle_key", "dim_component": "component_id", "dim_oem_group": "oem_group_id"}
    rows = None
    for name in catalog.existing(t.spark, [house.name(n) for n in _BUILT]):
        table = t.spark.table(name)
        met = table
        for dim, key in keys.items():
            met = met.join(house.table(dim).select(key), key, "left_semi") if key in met.columns else met
        counted = table.agg(F.count("*").alias("n_rows")).select(F.lit(name.split(".")[-1]).alias("table_name"), "n_rows", met.agg(F.count("*")).scalar().alias("n_met"))
        rows = counted if rows is None else rows.union(counted)
    return rows


@query(
    "table_contract",
    "SELECT * FROM (VALUES " + ", ".join(f"('{name}', TRUE, TRUE, '{TABLE_COMMENTS.get(name, '')}')" for name in EXPOSED) + ") AS v(table_name, present, queryable, description)",
)
def table_contract(t: Tables):
    """The exposed tables exist, answer and carry their descriptions."""
    house = _ingested_once(t)
    house.build_typed()
    house.build_star()
    house.comment()
    told = [(n, next((r["data_type"] for r in t.spark.sql(f"DESCRIBE TABLE EXTENDED {house.name(n)}").collect() if r["col_name"] == "Comment"), "")) for n in EXPOSED]
    described = t.spark.createDataFrame(told, "table_name string, description string")
    return house.check_contract().join(described, "table_name")


@query(
    "column_comments",
    "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}', '{text.replace(chr(39), chr(39) * 2)}')" for (t, c), text in COLUMN_COMMENTS.items()) + ") AS v(table_name, column_name, description)",
)
def column_comments(t: Tables):
    """Descriptions of columns, read back from the catalog."""
    house = _ingested_once(t)
    house.build_typed()
    house.build_star()
    house.comment()
    rows = []
    for table in dict.fromkeys(name for name, _ in COLUMN_COMMENTS):
        said = {f.name: f.metadata.get("comment") for f in house.table(table).schema.fields} if house.has(table) else {}
        rows += [(table, c, said.get(c)) for name, c in COLUMN_COMMENTS if name == table]
    return t.spark.createDataFrame(rows, "table_name string, column_name string, description string")


@query("replaced_table", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def replaced_table(t: Tables):
    """A partitioned, described table replaced by a part of itself keeps its name, partitions and description."""
    name = f"{_schema(t)}.orders"
    catalog.rebuild(t.orders.select("o_orderkey", "o_orderstatus"), name, "o_orderstatus")
    t.spark.sql(f"COMMENT ON TABLE {name} IS 'kept'")
    catalog.replace_with(t.spark, name, t.spark.table(name).where("o_orderstatus <> 'F'"))
    return t.spark.table(name)


# --------------------------------------------------------------------- corpus

_CASES = f"""{sqltext.TYPED_INVESTIGATIONS}, {sqltext.TYPED_BULLETINS.replace(sqltext.NAMES + ', ', '')}"""


@query(
    "parsed_text_chunks",
    f"""WITH {_CASES}, c AS (SELECT DISTINCT nhtsa_action_number AS a FROM investigations), b AS (SELECT DISTINCT tsb_id AS a FROM bulletins),
        x AS (SELECT 'investigation' AS d, a || '__x' AS i, 'Case file ' || a AS t FROM c UNION ALL SELECT 'tsb', a, 'Parsed ' || a FROM b)
        SELECT sha256(d || '::' || i || '::0') AS chunk_id, d AS source_dataset, i AS source_id, i AS parent_doc_id, 0 AS chunk_idx, t AS content FROM x""",
)
def parsed_text_chunks(t: Tables):
    """Parsed documents of bulletins and investigations take the place of the summaries."""
    day = feeds.as_of()
    cases, bulletins = typed.investigations(feeds.raw_investigations(t), day), typed.bulletins(feeds.raw_bulletins(t), day)
    files = cases.select("nhtsa_action_number").distinct().select(
        F.concat("nhtsa_action_number", F.lit("__x")).alias("doc_id"), F.concat(F.lit("Case file "), "nhtsa_action_number").alias("full_text")
    )
    texts = bulletins.select("tsb_id").distinct().select(F.col("tsb_id").alias("doc_id"), F.concat(F.lit("Parsed "), "tsb_id").alias("full_text"))
    chunks = corpus.narrative_chunks([corpus.from_investigations(cases, files), corpus.from_bulletins(bulletins, texts)])
    return chunks.select("chunk_id", "source_dataset", "source_id", "parent_doc_id", "chunk_idx", "content")

