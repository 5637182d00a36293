"""Document payloads: JSON listings, parsed-document elements, links in pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Element kinds left out of a document's text.
SKIPPED_ELEMENTS = ("page_footer", "page_number")
_PARSED = (
    "struct<document:struct<elements:array<struct<content:string,description:string,type:string>>>,text:string>"
)


def document_text(parsed: Column | str) -> Column:
    """Text of a parsed document held as JSON.

    Elements in order, without footers and page numbers, content before description, joined by
    line breaks; without any, the top-level ``text``; without that, the JSON itself.
    """
    raw = F.col(parsed) if isinstance(parsed, str) else parsed
    doc = F.from_json(raw, _PARSED)

    def said(e: Column) -> Column:
        return F.coalesce(F.nullif(e["content"], F.lit("")), e["description"])

    kept = F.filter(doc["document"]["elements"], lambda e: ~e["type"].isin(*SKIPPED_ELEMENTS) & said(e).isNotNull())
    joined = F.nullif(F.array_join(F.transform(kept, said), "\n"), F.lit(""))
    return F.coalesce(joined, doc["text"], raw)


def _field(item: Column, *names: str) -> Column:
    """First field that is present and not empty."""
    return F.coalesce(*[F.nullif(F.try_variant_get(item, f"$.{n}", "string"), F.lit("")) for n in names])


def _list(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def listed_documents(body: Column | str) -> Column:
    """``array<struct<url,title>>`` out of a listing body; NULL when the body is not JSON.

    The nested envelope (results / investigations / associatedDocuments) wins when it yields
    anything; else the first list under documents, results, data or items, or a bare list.
    """
    raw = F.col(body) if isinstance(body, str) else body
    payload = F.try_parse_json(raw)
    empty = F.expr("CAST(array() AS array<variant>)")

    def entries(items: Column, urls: tuple[str, ...], titles: tuple[str, ...]) -> Column:
        found = F.transform(
            items, lambda it: F.struct(_field(it, *urls).alias("url"), _field(it, *titles).alias("title"))
        )
        return F.filter(found, lambda e: e["url"].isNotNull())

    cases = F.flatten(
        F.transform(
            F.coalesce(_list(payload, "$.results"), empty),
            lambda r: F.coalesce(_list(r, "$.investigations"), empty),
        )
    )
    nested_items = F.flatten(F.transform(cases, lambda c: F.coalesce(_list(c, "$.associatedDocuments"), empty)))
    nested = entries(nested_items, ("url",), ("summary", "fileName"))

    flat_items = F.coalesce(
        _list(payload, "$.documents"),
        _list(payload, "$.results"),
        _list(payload, "$.data"),
        _list(payload, "$.items"),
        _list(payload, "$"),
        empty,
    )
    flat = entries(flat_items, ("url", "documentUrl", "documentURL", "href"), ("title", "documentTitle", "name"))
    return F.when(payload.isNotNull(), F.when(F.size(nested) > 0, nested).otherwise(flat))


def _collapse_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a path, any number of them, up to its query or fragment."""
    own = F.regexp_extract(path, r"(?s)\A[^?#]*", 0)
    parts = F.split(own, "/")
    ends_in_dots = F.element_at(parts, -1).isin(".", "..")
    parts = F.when(ends_in_dots, F.array_append(parts, F.lit(""))).otherwise(parts)
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part == ".", kept)
        .when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1))))
        .otherwise(F.array_append(kept, part)),
    )
    return F.concat(F.array_join(folded, "/"), F.substr(path, F.length(own) + 1))


def resolve_url(base: Column, link: Column) -> Column:
    """A link as an absolute URL, seen from the page at ``base``."""
    origin = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    no_fragment = F.regexp_replace(base, r"(?s)#.*\z", "")
    no_query = F.regexp_replace(no_fragment, r"(?s)\?.*\z", "")
    base_path = F.substr(no_query, F.length(origin) + 1)
    folder = F.coalesce(F.nullif(F.regexp_replace(base_path, r"[^/]*\z", ""), F.lit("")), F.lit("/"))

    def rooted(path: Column) -> Column:
        dotted = path.rlike(r"/\.\.?(?:[/?#]|\z)")
        return F.concat(origin, F.when(dotted, _collapse_dots(path)).otherwise(path))

    return (
        F.when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("/")), rooted(link))
        .when(F.startswith(link, F.lit("#")), F.concat(no_fragment, link))
        .when(F.startswith(link, F.lit("?")), F.concat(no_query, link))
        .otherwise(rooted(F.concat(folder, link)))
    )


def page_links(html: Column | str, base: Column, suffix: str = r"\.pdf") -> Column:
    """Distinct links of a page in order of appearance, made absolute; ``suffix`` is a pattern."""
    page = F.col(html) if isinstance(html, str) else html
    found = F.regexp_extract_all(page, F.lit(rf'(?i)href="([^"]+?{suffix})"'), F.lit(1))
    return F.array_distinct(F.transform(found, lambda link: resolve_url(base, link)))

