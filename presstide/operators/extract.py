"""Pages to metadata documents, as one projection over the HTML column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as sc
from ..functions.urlkeys import as_col

# Named entities that are decoded; numeric ones all are.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·"}
NUMERIC = r"&#(?:[0-9]{1,9}|[xX][0-9a-fA-F]{1,7});"


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _plain(html: Column) -> Column:
    """Tags and scripts out, entities decoded, blanks collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    return F.btrim(F.regexp_replace(_decoded(text), r"\s+", " "))


def _unquoted(value: Column) -> Column:
    quoted = value.startswith('"') | value.startswith("'")
    return F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def _numeric(text: Column) -> Column:
    """Numeric entities decoded; the replacement character for numbers that name none.

    An ampersand is left as a named entity, so that it begins no other.
    """

    def piece(p: Column) -> Column:
        hexadecimal = F.lower(F.substr(p, F.lit(3), F.lit(1))) == "x"
        digits = F.when(hexadecimal, F.conv(F.substr(p, F.lit(4), F.length(p) - 4), 16, 10)).otherwise(F.substr(p, F.lit(3), F.length(p) - 3))
        code = digits.cast("int")
        none = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(none, 0xFFFD).otherwise(code)), 8, "0")), "UTF-32")
        return F.when(p.rlike(f"^{NUMERIC}$"), F.when(code == 38, "&amp;").when(code == 160, " ").otherwise(char)).otherwise(p)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s){NUMERIC}|[^&]+|&"), F.lit(0))
    return F.array_join(F.transform(pieces, piece), "")


def _decoded(text: Column) -> Column:
    text = _numeric(text)
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def page_title(html: Column | str) -> Column:
    raw = F.regexp_extract(as_col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return _some(_plain(raw))


def page_language(html: Column | str) -> Column:
    return _some(F.regexp_extract(as_col(html), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([^"'\s>]*)""", 1))


def page_links(html: Column | str) -> Column:
    """Link targets in page order."""
    found = F.regexp_extract_all(as_col(html), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    return F.transform(found, lambda h: F.struct(_decoded(_unquoted(h)).alias("href")))


def page_article(html: Column | str) -> Column:
    """Markup of the article element, or of the body without one."""
    h = as_col(html)
    article = _some(F.regexp_extract(h, r"(?is)<article\b[^>]*>(.*)</article\s*>", 1))
    body = _some(F.regexp_extract(h, r"(?is)<body\b[^>]*>(.*)</body\s*>", 1))
    return F.coalesce(article, body)


def page_text(html: Column | str) -> Column:
    return _some(_plain(page_article(html)))


def page_description(html: Column | str) -> Column:
    return page_meta(html, "name", "description")


def page_meta(html: Column | str, attribute: str, value: str) -> Column:
    """``content`` of the first meta tag with this attribute, in either order and quoting."""
    tag = F.regexp_extract(as_col(html), rf"""(?is)<meta\b[^>]*\b{attribute}\s*=\s*["']?{value}(?=["'\s/>])[^>]*>""", 0)
    content = F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return _some(_decoded(_unquoted(content)))


def page_author(html: Column | str) -> Column:
    return page_meta(html, "name", "author")


def page_published(html: Column | str) -> Column:
    return page_meta(html, "property", "article:published_time")


def page_modified(html: Column | str) -> Column:
    return page_meta(html, "property", "article:modified_time")


def page_canonical(html: Column | str) -> Column:
    """Address of the canonical link, its attributes in either order."""
    tag = F.regexp_extract(as_col(html), r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical(?=["'\s/>])[^>]*>""", 0)
    return _some(_decoded(_unquoted(F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1))))


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add title, description, language, author, published, modified, canonical,
    links, content_html, content_text, error.

    A page without markup gets ``error`` with type, message and location; its
    row stays and no task fails.
    """
    h = F.col(html_col)
    bad = h.isNull() | ~h.contains("<")
    error = F.when(
        bad,
        F.struct(
            F.when(h.isNull(), "empty").otherwise("no markup").alias("type"),
            F.lit("page cannot be parsed").alias("message"),
            F.lit("extract").alias("location"),
        ),
    )
    return pages.withColumns(
        {
            "title": page_title(h),
            "description": page_description(h),
            "language": page_language(h),
            "author": page_author(h),
            "published": page_published(h),
            "modified": page_modified(h),
            "canonical": page_canonical(h),
            "links": page_links(h),
            "content_html": page_article(h),
            "content_text": page_text(h),
            "error": error,
        }
    )


#: How much of a span a time of each written length covers, by its number of characters.
SPANS = {4: "INTERVAL 1 YEAR", 7: "INTERVAL 1 MONTH", 10: "INTERVAL 1 DAY"}
ISO = "yyyy-MM-dd HH:mm:ss"


def time_span(written: Column | str) -> Column:
    """Struct lo, hi of a written time: a year, month or day spans all of it.

    ``hi`` is where the next one begins; a time of day is its own end. Null
    where nothing readable is written.
    """
    # Spark reads a bare time of day as one of today, so a year has to come first.
    text = F.regexp_extract(F.btrim(as_col(written)), r"(?s)^[0-9]{4}($|-.*)", 0)
    whole = F.when(F.length(text) == 4, F.concat(text, F.lit("-01-01"))).when(F.length(text) == 7, F.concat(text, F.lit("-01")))
    lo = sc.parse_time(F.coalesce(whole, text))
    hi = lo
    for length, step in SPANS.items():
        hi = F.when(F.length(text) == length, lo + F.expr(step)).otherwise(hi)
    return F.when(lo.isNotNull(), F.struct(F.date_format(lo, ISO).alias("lo"), F.date_format(hi, ISO).alias("hi")))


def page_document(url: Column | str, html: Column | str, version: str = "1") -> Column:
    """The metadata document of a page, typed as the captures' ``doc`` is.

    Every key has ``best.value``, or is null where the page says nothing. A
    page without markup carries only its exception. A page that names a
    publication time, or an article element, is an ``article``. Content links
    are those of the article's own markup.
    """
    h = as_col(html)
    bad = h.isNull() | ~h.contains("<")
    body = page_article(h)

    def best(value: Column, present: Column | None = None) -> Column:
        here = value.isNotNull() if present is None else present
        return F.when(~bad & here, F.struct(F.struct(value.alias("value")).alias("best")))

    published = time_span(page_published(h))
    is_article = published.isNotNull() | h.rlike(r"(?i)<article\b")
    failure = F.struct(
        F.lit("page cannot be parsed").alias("str(e)"),
        F.when(h.isNull(), "empty").otherwise("no markup").alias("type"),
        F.lit("extract").alias("location"),
        F.lit("").alias("traceback"),
    )
    return F.struct(
        best(page_author(h)).alias("author"),
        best(page_language(h)).alias("language"),
        best(page_title(h)).alias("title"),
        # A null description still has its key: articles need the key, not a value.
        best(page_description(h), F.lit(True)).alias("description"),
        best(F.lit("article"), is_article).alias("type"),
        best(F.struct(body.alias("html"), page_text(h).alias("text")), body.isNotNull()).alias("content"),
        best(F.coalesce(page_canonical(h), as_col(url))).alias("url.canonical"),
        best(published).alias("timestamp.published"),
        best(time_span(page_modified(h))).alias("timestamp.modified"),
        best(page_links(h)).alias("links.all"),
        best(page_links(body)).alias("links.content"),
        F.lit(version).alias("version"),
        F.when(bad, failure).alias("exception"),
    )


def to_captures(records: DataFrame, id_col: str, source_col: str, html_col: str = "html", version: str = "1") -> DataFrame:
    """Page records (url, accessed_at, html) to captures: id, id_source, accessed_at, url, doc.

    ``accessed_at`` may be text. Nothing is shuffled and no row is dropped.
    """
    return records.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("id_source"),
        sc.parse_time(F.col("accessed_at").cast("string")).alias("accessed_at"),
        "url",
        page_document("url", html_col, version).alias("doc"),
    )
