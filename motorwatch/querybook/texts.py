"""Documents, pages, chunks, corpus, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.payloads import document_text, page_links
from ..functions.text import html_to_text, truncate_with_marker
from ..operators import sampling, worklist
from ..operators.chunking import ChunkSpec, explode_chunks
from ..plans import corpus, typed
from ..sources.documents import api_results as results
from ..sources.documents import document_rows, listing_entries
from . import feeds, sqltext
from .registry import Tables, query

_ORIGIN = "regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)"
_FOLDER = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '')"


# ------------------------------------------------------------- chunks, corpus


def _chunk_sql(size: int, overlap: int, sep: str) -> str:
    return f"""WITH RECURSIVE source AS (SELECT doc_id, text AS t FROM documents), {sqltext.chunk_ctes('source', 'doc_id', size, overlap, sep)}
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_idx, c AS content FROM pieces WHERE c <> ''"""


@query("chunk_docs", _chunk_sql(400, 50, "'. '"))
def chunk_docs(t: Tables):
    """Soft breaks at sentence ends."""
    return explode_chunks(t.documents.select("doc_id", "text"), "text", ChunkSpec(400, 50, ". "))


@query("chunk_docs_hard", _chunk_sql(800, 100, "chr(10) || chr(10)"))
def chunk_docs_hard(t: Tables):
    """The default window; texts without a blank line are cut at a fixed stride."""
    return explode_chunks(t.documents.select("doc_id", "text"), "text")


@query(
    "narrative_chunks",
    f"""WITH RECURSIVE {sqltext.TYPED_COMPLAINTS}, {sqltext.TYPED_BULLETINS.replace(sqltext.NAMES + ', ', '')}, {feeds.SQL_RAW_CRASHES},
      {sqltext.TYPED_INVESTIGATIONS.replace(sqltext.NAMES + ', ', '')},
      cases AS (SELECT *, row_number() OVER (PARTITION BY nhtsa_action_number ORDER BY mfr_norm NULLS FIRST, component_group NULLS FIRST,
          oem_group NULLS FIRST, open_date NULLS FIRST) AS nth FROM investigations),
      crashes AS (SELECT report_id, narrative, {sqltext.make_norm('make')} AS make_norm, {sqltext.oem_group('make')} AS oem_group,
          coalesce(try_strptime(incident_date, '%Y-%m-%d'), try_strptime(incident_date, '%m/%d/%Y'), try_strptime(incident_date, '%b-%Y'))::DATE AS event_date
        FROM {sqltext.with_names('raw_crashes', 'make')}),
      texts AS (
        SELECT 'complaints' AS source_dataset, odi_number AS source_id, NULL AS parent_doc_id, {sqltext.masked('cdescr')} AS t,
          make_norm, model_norm, model_year, component_group, oem_group, incident_date AS event_date FROM complaints
        UNION ALL SELECT 'tsb', tsb_id, tsb_id, summary, make_norm, model_norm, model_year, component_group, oem_group, original_date FROM bulletins
        UNION ALL SELECT 'investigation', nhtsa_action_number || '__x', nhtsa_action_number || '__x', 'Case file ' || nhtsa_action_number,
          mfr_norm, NULL, NULL, component_group, oem_group, open_date FROM cases WHERE nth = 1
        UNION ALL SELECT 'sgo', report_id, report_id, narrative, make_norm, NULL, NULL, NULL, oem_group, event_date FROM crashes),
      source AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_dataset, source_id, t ORDER BY
          make_norm NULLS FIRST, model_norm NULLS FIRST, model_year NULLS FIRST, component_group NULLS FIRST, oem_group NULLS FIRST, event_date NULLS FIRST) AS rn
        FROM texts) WHERE rn = 1),
      {sqltext.chunk_ctes('source', 'source_dataset, source_id, parent_doc_id, make_norm, model_norm, model_year, component_group, oem_group, event_date', 800, 100, 'chr(10) || chr(10)')},
      numbered AS (SELECT *, row_number() OVER (PARTITION BY source_dataset, source_id ORDER BY i) - 1 AS chunk_idx FROM pieces WHERE c <> '')
      SELECT sha256(source_dataset || '::' || source_id || '::' || chunk_idx) AS chunk_id, source_dataset, source_id, parent_doc_id,
        chunk_idx::INTEGER AS chunk_idx, c AS content, make_norm, model_norm, model_year, component_group, oem_group, event_date,
        'vectors-1' AS embedding_model FROM numbered""",
)
def narrative_chunks(t: Tables):
    """All four sources; the investigations' documents are made here, one per case."""
    day = feeds.as_of()
    cases = typed.investigations(feeds.raw_investigations(t), day)
    number = F.col("nhtsa_action_number")
    files = cases.select(number).distinct().select(
        F.concat(number, F.lit("__x")).alias("doc_id"), F.concat(F.lit("Case file "), number).alias("full_text")
    )
    sources = [
        corpus.from_investigations(cases, files),
        corpus.from_complaints(typed.complaints(feeds.raw_complaints(t), day)),
        corpus.from_bulletins(typed.bulletins(feeds.raw_bulletins(t), day)),
        corpus.from_av_crashes(typed.av_crashes(feeds.raw_crashes(t))),
    ]
    return corpus.narrative_chunks(sources, embedding_model="vectors-1").drop("_chunked_at")


@query(
    "doc_meta_left_join",
    f"""WITH {sqltext.TYPED_BULLETINS}, meta AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tsb_id ORDER BY make_norm NULLS FIRST,
          model_norm NULLS FIRST, model_year NULLS FIRST, component_group NULLS FIRST, oem_group NULLS FIRST, original_date NULLS FIRST) AS rn FROM bulletins) WHERE rn = 1)
      SELECT 'tsb' AS source_dataset, 'SB-' || doc_id AS source_id, md5(text) AS body, make_norm, model_norm, model_year, component_group, oem_group,
        original_date AS event_date FROM documents LEFT JOIN meta ON 'SB-' || doc_id = tsb_id""",
)
def doc_meta_left_join(t: Tables):
    """Parsed bulletin texts and the bulletin's metadata, one row per text."""
    parsed = t.documents.select(F.concat(F.lit("SB-"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("text").alias("full_text"))
    rows = corpus.from_bulletins(typed.bulletins(feeds.raw_bulletins(t), feeds.as_of()), parsed)
    return rows.withColumn("body", F.md5("body")).drop("parent_doc_id")


@query(
    "case_document_join",
    f"""WITH {sqltext.TYPED_INVESTIGATIONS}, docs AS (SELECT nhtsa_action_number || '__' || substring(sha1(nhtsa_action_number), 1, 16) AS doc_id, nhtsa_action_number
          FROM (SELECT DISTINCT nhtsa_action_number FROM investigations)),
        meta AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nhtsa_action_number ORDER BY mfr_norm NULLS FIRST, component_group NULLS FIRST,
          oem_group NULLS FIRST, open_date NULLS FIRST) AS rn FROM investigations) WHERE rn = 1)
      SELECT doc_id AS source_id, mfr_norm AS make_norm, component_group, oem_group, open_date AS event_date FROM docs JOIN meta USING (nhtsa_action_number)""",
)
def case_document_join(t: Tables):
    """Document ids carry their case before the double underscore."""
    cases = typed.investigations(feeds.raw_investigations(t), feeds.as_of())
    number = F.col("nhtsa_action_number")
    parsed = cases.select("nhtsa_action_number").distinct().select(
        F.concat(number, F.lit("__"), F.substring(F.sha1(number), 1, 16)).alias("doc_id"), number.alias("full_text")
    )
    rows = corpus.from_investigations(cases, parsed)
    return rows.select("source_id", "make_norm", "component_group", "oem_group", "event_date")


@query(
    "date_buckets",
    """SELECT CASE WHEN o_orderkey % 13 = 0 THEN '~null (excluded)' WHEN o_orderdate >= DATE '2016-01-01' THEN 'post_2015'
         WHEN o_orderdate >= DATE '2000-01-01' THEN 'y2000_2015' ELSE 'pre_2000' END AS bucket, count(*) AS n FROM orders GROUP BY 1""",
)
def date_buckets(t: Tables):
    return _dated(t).groupBy(corpus.date_bucket().alias("bucket")).agg(F.count("*").alias("n"))


def _dated(t: Tables):
    day = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate").cast("date"))
    return t.orders.select("o_orderkey", "o_orderstatus", day.alias("event_date"))


# ------------------------------------------------------------------- samples


@query(
    "stratified_sample",
    """WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), target(source, size) AS (VALUES ('src1', 20), ('src2', 1000000), ('src3', 5))
       SELECT doc_id, d.source FROM documents d JOIN n USING (source) JOIN target USING (source)
       WHERE ('0x' || substring(md5('42|' || doc_id), 1, 8))::UBIGINT / 4294967296.0 < least(1.0, size / n)""",
)
def stratified_sample(t: Tables):
    targets = {"src1": 20, "src2": 1_000_000, "src3": 5}
    return sampling.stratified(t.documents.select("doc_id", "source"), "source", targets, ["doc_id"])


@query(
    "bucket_sample",
    """WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderdate >= DATE '2016-01-01' THEN 'post_2015'
         WHEN o_orderdate >= DATE '2000-01-01' THEN 'y2000_2015' ELSE 'pre_2000' END AS bucket FROM orders),
       r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('42|' || o_orderkey), o_orderkey) AS rn FROM d WHERE bucket IS NOT NULL)
       SELECT o_orderkey, bucket FROM r WHERE rn <= CASE bucket WHEN 'pre_2000' THEN 500 WHEN 'y2000_2015' THEN 700 ELSE 1000000 END""",
)
def bucket_sample(t: Tables):
    """An exact number per date bucket; undated rows never."""
    rows = _dated(t).where("event_date IS NOT NULL").withColumn("bucket", corpus.date_bucket())
    sizes = {"pre_2000": 500, "y2000_2015": 700, "post_2015": 1_000_000}
    return sampling.exact_sizes(rows, ["o_orderkey"], F.col("bucket"), sizes).select("o_orderkey", "bucket")


# ----------------------------------------------------------- pages, documents


@query(
    "html_links",
    f"""WITH found AS (SELECT page_id, {_ORIGIN} AS origin, unnest(list_distinct(regexp_extract_all(html, '(?i)href="([^"]+?)"', 1))) AS link FROM pages)
        SELECT DISTINCT page_id, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link ELSE origin || link END AS url FROM found""",
)
def html_links(t: Tables):
    """All links of each page, absolute; the given pages link to no PDF, so any suffix counts."""
    links = page_links("html", F.col("url"), suffix="")
    return t.pages.select("page_id", F.explode(links).alias("link")).withColumnRenamed("link", "url")


_LISTING = {
    0: """'{"results":[{"investigations":[{"associatedDocuments":[{"url":"' || url || '","summary":"s' || page_id || '"},{"url":"/files/' || page_id || '.pdf","fileName":"f' || page_id || '"},{"summary":"no url"}]}]}]}'""",
    1: """'{"documents":[{"documentUrl":"' || url || '","documentTitle":"t' || page_id || '"},{"href":"b.pdf","name":""}]}'""",
    2: """'[{"url":"c' || page_id || '.pdf","name":"n"}]'""",
    3: "html",
    4: """'{"results":[{"url":"?v=1","title":"flat"}],"items":[]}'""",
}


@query(
    "listing_json_docs",
    f"""WITH p AS (SELECT *, {_ORIGIN} AS origin, {_FOLDER} AS folder FROM pages),
      h AS (SELECT page_id, origin, regexp_extract_all(html, '(?i)href="([^"]+?)"', 1) AS links FROM p WHERE page_id % 5 = 3),
      hl AS (SELECT page_id, origin, unnest(links) AS link, generate_subscripts(links, 1) AS nth FROM h),
      hd AS (SELECT page_id, origin || link AS url, min(nth) AS nth FROM hl GROUP BY ALL)
      SELECT page_id, 0 AS pos, url, 's' || page_id AS title FROM p WHERE page_id % 5 = 0
      UNION ALL SELECT page_id, 1, origin || '/files/' || page_id || '.pdf', 'f' || page_id FROM p WHERE page_id % 5 = 0
      UNION ALL SELECT page_id, 0, url, 't' || page_id FROM p WHERE page_id % 5 = 1
      UNION ALL SELECT page_id, 1, folder || 'b.pdf', NULL FROM p WHERE page_id % 5 = 1
      UNION ALL SELECT page_id, 0, folder || 'c' || page_id || '.pdf', 'n' FROM p WHERE page_id % 5 = 2
      UNION ALL SELECT page_id, 0, regexp_replace(url, '[?#].*$', '') || '?v=1', 'flat' FROM p WHERE page_id % 5 = 4
      UNION ALL SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY nth) - 1)::INTEGER, url, NULL FROM hd""",
)
def listing_json_docs(t: Tables):
    """Nested, flat, bare and broken listings made from the pages."""
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in _LISTING.items())
    bodies = t.pages.select("page_id", F.col("url").alias("base"), F.expr(f"CASE page_id % 5 {cases} END").alias("body"))
    return listing_entries(bodies, "body", F.col("base"), suffix="").drop("base")


@query(
    "api_results",
    """SELECT part_key, 'C' || s AS campaign, s * 10 AS units FROM (SELECT p_partkey AS part_key, unnest(range(1, p_size % 4 + 1)) AS s FROM part WHERE p_type <> 'PROMO')""",
)
def api_results(t: Tables):
    """Stored responses, made from the parts: a list of results, an empty one, or no list at all."""
    rows = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<struct<campaign:string,units:bigint>>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest((F.col("p_size") % 4).cast("int"), F.lit(1))),
            lambda s: F.struct(
                F.concat(F.lit("C"), s.cast("string")).alias("campaign"), (s * 10).cast("bigint").alias("units")
            ),
        )
    )
    body = F.when(F.col("p_type") == "PROMO", F.lit('{"message":"not found"}')).otherwise(
        F.to_json(F.struct(rows.alias("results")))
    )
    return results(t.part.select(F.col("p_partkey").alias("part_key"), body.alias("body")), "body", "campaign:string,units:bigint")


@query(
    "doc_ids",
    """WITH found AS (SELECT DISTINCT page_id, 'PE 22/' || page_id AS action, unnest(regexp_extract_all(html, '(?i)href="([^"]+?)"', 1)) AS link, url FROM pages),
       f AS (SELECT DISTINCT action, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || link AS u FROM found)
       SELECT action || '__' || substring(sha1(u), 1, 16) AS document_id, action AS nhtsa_action_number, u AS document_url, NULL::VARCHAR AS document_title,
         '/docs/' || regexp_replace(action, '[^A-Za-z0-9._-]+', '_', 'g') || '__' || substring(sha1(u), 1, 10) || '.pdf' AS volume_path,
         regexp_replace(action, '[^A-Za-z0-9._-]+', '_', 'g') || '__' || substring(sha1(u), 1, 10) || '.pdf' AS file_name FROM f""",
)
def doc_ids(t: Tables):
    pages = t.pages.select(
        F.concat(F.lit("PE 22/"), F.col("page_id").cast("string")).alias("nhtsa_action_number"),
        F.col("url").alias("base"),
        F.col("html").alias("body"),
    )
    entries = listing_entries(pages, "body", F.col("base"), suffix="")
    return document_rows(entries, "/docs/")


_TEXT_SQL = r"""trim(regexp_replace({unescaped}, '[ \t\r\n\f]+', ' ', 'g'))"""


def _html_sql() -> str:
    out = "html"
    for pattern in (
        r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>",
        r"(?s)<!--.*?-->",
        r"(?s)<[^>]*>",
    ):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    return _TEXT_SQL.format(unescaped=out)


@query("html_to_text", f"SELECT page_id, {_html_sql()} AS text FROM pages")
def page_text(t: Tables):
    return t.pages.select("page_id", html_to_text("html").alias("text"))


@query(
    "parse_tracker",
    f"""SELECT page_id::VARCHAR AS doc_id, url AS volume_path, {_html_sql()} AS full_text, 'html/1' AS parser_version,
          CASE WHEN {_html_sql()} = '' THEN 'error' ELSE 'ok' END AS parse_status,
          CASE WHEN {_html_sql()} = '' THEN 'document has no text' END AS error_message FROM pages""",
)
def parse_tracker(t: Tables):
    work = t.pages.select(F.col("page_id").cast("string").alias("doc_id"), F.col("url").alias("volume_path"), "html")
    return worklist.track(work, html_to_text("html"), "html/1").drop("parsed_at")


_ELEMENT_KINDS = ("text", "page_footer", "page_number", "figure")


@query(
    "assemble_text",
    """WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
       said AS (SELECT doc_id, text, list_filter(list_transform(range(1, len(parts) + 1), lambda i:
            CASE WHEN i % 4 IN (2, 3) THEN NULL WHEN i % 5 = 0 THEN nullif('see ' || i, '') ELSE nullif(parts[i], '') END), lambda x: x IS NOT NULL) AS kept FROM lines)
       SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'plain ' || doc_id WHEN doc_id % 7 = 1 THEN '{"note":' || doc_id || '}'
            WHEN len(kept) = 0 THEN 'plain' ELSE array_to_string(kept, chr(10)) END AS full_text FROM said""",
)
def assemble_text(t: Tables):
    """Documents turned into parser output, line by line, and put together again."""
    kinds = F.array(*[F.lit(k) for k in _ELEMENT_KINDS])
    element = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.try_element_at(kinds, F.pmod(i, F.lit(4)).cast("int") + 1).alias("type"),
            F.when((i + 1) % 5 != 0, line).otherwise("").alias("content"),
            F.when((i + 1) % 5 == 0, F.concat(F.lit("see "), (i + 1).cast("string"))).alias("description"),
        ),
    )
    key = F.col("doc_id")
    payload = (
        F.when(key % 7 == 0, F.to_json(F.struct(F.concat(F.lit("plain "), key.cast("string")).alias("text"))))
        .when(key % 7 == 1, F.to_json(F.struct(key.alias("note"))))
        .otherwise(
            F.to_json(F.struct(F.struct(element.alias("elements")).alias("document"), F.lit("plain").alias("text")))
        )
    )
    return t.documents.select("doc_id", payload.alias("parsed")).select("doc_id", document_text("parsed").alias("full_text"))


@query(
    "truncated_payloads",
    """SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE substring(text, 1, 500) || '... [TRUNCATED ' || (length(text) - 500)
         || ' chars — narrow your filters or lower num_results]"' END AS payload FROM documents""",
)
def truncated_payloads(t: Tables):
    return t.documents.select("doc_id", truncate_with_marker("text", 500).alias("payload"))


# ------------------------------------------------------------------ backlogs


@query(
    "anti_join_worklist",
    "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id) ORDER BY doc_id LIMIT 200",
)
def anti_join_worklist(t: Tables):
    """The next 200 documents without a label."""
    return worklist.pending(t.documents.select("doc_id"), t.labels, "doc_id", budget=200)


@query("backlog", "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def backlog(t: Tables):
    return worklist.pending(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query(
    "unscraped_ids",
    f"""WITH {feeds.SQL_RAW_INVESTIGATIONS}, done AS (SELECT DISTINCT nhtsa_action_number FROM raw_investigations WHERE subject = '1-URGENT')
        SELECT DISTINCT nhtsa_action_number FROM raw_investigations ANTI JOIN done USING (nhtsa_action_number)
        WHERE action_open_date >= '19980101'""",
)
def unscraped_ids(t: Tables):
    cases = feeds.raw_investigations(t)
    scraped = cases.where("subject = '1-URGENT'").select("nhtsa_action_number")
    return worklist.unscraped(cases, scraped, "nhtsa_action_number", "action_open_date", "19980101")
