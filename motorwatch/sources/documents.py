"""Binary documents, document listings, pages, and document rows with stable ids."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import document_id
from ..functions.payloads import listed_documents, page_links, resolve_url
from ..functions.text import safe_file_part


#: Bytes of documents that a task holds at a time, about.
_HELD = 1 << 20


def file_system(uri: str):
    """The file system that Arrow knows for a URI as Hadoop writes it, and the path there."""
    from pyarrow import fs

    local = re.match(r"(?:file:)?/+", uri)
    return (fs.LocalFileSystem(), "/" + uri[local.end() :]) if local else fs.FileSystem.from_uri(uri)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below a folder: ``_file`` as its file system names it, and ``_path``, the same without a scheme."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_replace("path", r"\A[a-z]+:/*", "/").alias("_path"), F.col("path").alias("_file"))


def load_binaries(
    spark: SparkSession, wanted: DataFrame, folder: str, *, path: str = "volume_path", files: DataFrame | None = None
) -> DataFrame:
    """Document bytes joined to a worklist; ``content`` is NULL where the file is missing.

    Missing files stay in the result, so that the caller can record them instead of queueing
    them again for ever. The folder is only listed: paths meet the worklist, the matches are dealt to all cores, however few bytes
    their paths have, and the tasks that get them open these files themselves, so bytes are neither read in vain nor moved.
    ``files`` is the folder's :func:`list_files`, kept by a caller of many runs over a folder that stays as it is.
    """
    files = list_files(spark, folder) if files is None else files
    target = F.regexp_replace(F.col(path), r"\A(?:[a-z]+:)?/+", "/")
    found = wanted.join(files, target == F.col("_path"), "left").select(F.struct(*wanted.columns).alias("row"), "_file")
    schema = T.StructType([found.schema["row"], T.StructField("content", T.BinaryType())])

    def content(uri: str | None) -> bytes | None:
        if uri is None:
            return None
        system, name = file_system(uri)
        with system.open_input_stream(name) as stream:
            return stream.read()

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            for i in range(batch.num_rows):
                held.append(content(batch.column(1)[i].as_py()))
                size += len(held[-1] or b"")
                if size >= _HELD or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), pa.array(held, pa.binary())], names=["row", "content"])
                    first, held, size = i + 1, [], 0

    dealt = found.repartition(4 * spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(load, schema).select("row.*", "content")


def listing_entries(bodies: DataFrame, body: str, base: Column, *, suffix: str = r"\.pdf") -> DataFrame:
    """One row per document named in a listing body: JSON first, links in the page otherwise.

    ``pos`` keeps the order. A JSON body without documents falls back to its links as well.
    """
    from_json = listed_documents(body)
    from_page = F.transform(
        page_links(body, base, suffix), lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("title"))
    )
    absolute = F.transform(
        from_json, lambda e: F.struct(resolve_url(base, e["url"]).alias("url"), e["title"].alias("title"))
    )
    entries = F.when(F.size(F.coalesce(from_json, F.array())) > 0, absolute).otherwise(from_page)
    others = [c for c in bodies.columns if c != body]
    return bodies.select(*others, F.posexplode(entries).alias("pos", "entry")).select(
        *others, "pos", F.col("entry.url").alias("url"), F.col("entry.title").alias("title")
    )


def api_results(bodies: DataFrame, body: str, row_schema: str) -> DataFrame:
    """Rows of the ``results`` list of stored API responses, next to the other columns.

    ``row_schema`` is the DDL of one row. A body without such a list yields nothing.
    """
    parsed = F.from_json(F.col(body), f"struct<results:array<struct<{row_schema}>>>")
    others = [c for c in bodies.columns if c != body]
    return bodies.select(*others, F.explode(parsed["results"]).alias("_r")).select(*others, "_r.*")


def document_rows(
    entries: DataFrame,
    folder: str,
    *,
    action: str = "nhtsa_action_number",
    url: str = "url",
    title: str = "title",
    max_docs: int | None = None,
) -> DataFrame:
    """Rows of the investigation-documents table, ids and file names derived from the URL.

    ``max_docs`` is the per-run budget of the scrape. It is cut at case borders, in order of the
    action: a case whose documents do not all fit waits for the next run, as one with some of its
    documents would count as done. The first case always goes, so that each run gets on.
    """
    rows = entries.where((F.col(action).isNotNull()) & (F.col(action) != ""))
    if max_docs is not None:
        cut = rows.orderBy(action).limit(max_docs).groupBy(action).agg(F.count("*").alias("_taken"))
        sizes = rows.groupBy(action).agg(F.count("*").alias("_size"))
        first = cut.agg(F.min(action)).scalar()
        whole = cut.join(sizes, action).where((F.col("_taken") == F.col("_size")) | (F.col(action) == first))
        rows = rows.join(whole.select(action), action, "left_semi")
    name = F.concat(
        safe_file_part(F.col(action), "inv"), F.lit("__"), F.substring(F.sha1(F.col(url)), 1, 10), F.lit(".pdf")
    )
    return rows.select(
        document_id(F.col(action), F.col(url)).alias("document_id"),
        F.col(action).alias("nhtsa_action_number"),
        F.col(url).alias("document_url"),
        F.col(title).alias("document_title"),
        F.concat(F.lit(folder.rstrip("/") + "/"), name).alias("volume_path"),
        name.alias("file_name"),
    )
