"""Raw pages to documents, captures and articles."""

import pytest
from pyspark.sql import functions as F

from presstide.operators import captures as cp
from presstide.operators import extract as ex

PAGE = (
    '<html lang="en-GB"><head><title>Rain &#38; wind &#8211; caf&#xE9;</title><meta name="description" content="A &quot;wet&quot; day">'
    '<meta property="article:published_time" content="{when}"><meta name=author content=Ana></head>'
    '<body><a href="/out">x</a><article><p>Heavy rain</p><a href="/in?a=1&amp;b=2">y</a></article></body></html>'
)


def rows(spark, *pages):
    data = [(i, "s", f"http://www.a.test/p{i}?utm_x=1", "2021-01-02T03:04:05Z", html) for i, html in enumerate(pages)]
    return spark.createDataFrame(data, "id int, src string, url string, accessed_at string, html string")


@pytest.mark.parametrize("written, lo, hi", [
    ("2020", "2020-01-01 00:00:00", "2021-01-01 00:00:00"),
    ("2020-02", "2020-02-01 00:00:00", "2020-03-01 00:00:00"),
    (" 2020-02-28 ", "2020-02-28 00:00:00", "2020-02-29 00:00:00"),
    ("2020-02-28T10:11:12Z", "2020-02-28 10:11:12", "2020-02-28 10:11:12"),
    ("garbage", None, None), ("2020-13", None, None), ("12:30:45", None, None), ("", None, None), (None, None, None),
])
def test_time_span(spark, written, lo, hi):
    got = spark.createDataFrame([(written,)], "t string").select(ex.time_span("t").alias("s")).first().s
    assert got == ((lo, hi) if lo else None)


def test_document_of_a_page(spark):
    r = ex.to_captures(rows(spark, PAGE.format(when="2020-02-28")), "id", "src").first()
    doc = r.doc.asDict(recursive=True)
    value = {k: v["best"]["value"] for k, v in doc.items() if isinstance(v, dict) and "best" in v}
    assert value["title"] == "Rain & wind – café" and value["description"] == 'A "wet" day'
    assert value["author"] == "Ana" and value["language"] == "en-GB" and value["type"] == "article"
    assert value["url.canonical"] == r.url and value["timestamp.published"] == {"lo": "2020-02-28 00:00:00", "hi": "2020-02-29 00:00:00"}
    assert value["links.all"] == [{"href": "/out"}, {"href": "/in?a=1&b=2"}] and value["links.content"] == [{"href": "/in?a=1&b=2"}]
    assert doc["timestamp.modified"] is None and doc["exception"] is None and str(r.accessed_at) == "2021-01-02 03:04:05"


def test_documents_have_the_type_of_captures(spark):
    doc = ex.to_captures(rows(spark, PAGE), "id", "src").select("doc")
    typed = doc.select(cp.typed_doc(F.to_json("doc", {"ignoreNullFields": "false"})).alias("d"))
    assert [f.name for f in doc.schema["doc"].dataType] == [f.name for f in typed.schema["d"].dataType]
    assert typed.select("d").first().d == doc.first().doc


def test_raw_pages_become_articles_or_name_what_is_missing(spark):
    pages = [
        PAGE.format(when="2020-02-28"), PAGE.format(when="soon"), PAGE.replace("<title>", "<b>").format(when="2020"), "no markup", None, "",
        PAGE.replace(' lang="en-GB"', "").format(when="2020"), "<html lang=en><title>t</title>",
    ]
    captures = ex.to_captures(rows(spark, *pages), "id", "src")
    got = {r.id: r.reject for r in cp.article_candidates(captures, stops={}).select("id", "reject").collect()}
    assert got == {
        0: None, 1: "timestamp.published", 2: "title", 3: "language", 4: "language", 5: "language", 6: "language", 7: "timestamp.published",
    }
    art = cp.to_articles(captures, stops={}).first()
    assert (art.hostpath_surt, art.language, art.title) == ("test,a)/p0", "en", "Rain & wind – café")
    assert str(art.timestamp_published) == "2020-02-28 00:00:00"
    failed = captures.filter("doc.exception IS NOT NULL").select("id", "doc.exception.type").collect()
    assert {r.id: r.type for r in failed} == {3: "no markup", 4: "empty", 5: "no markup"}


def test_no_pages(spark):
    assert cp.to_articles(ex.to_captures(rows(spark, "x").limit(0), "id", "src")).count() == 0
