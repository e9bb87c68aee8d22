import json
import random

import pytest
from pyspark.sql import functions as F

from presstide.operators import captures as cp
from presstide.operators import extract as ex
from presstide.operators import links


def brute_first_wins(rows):
    keys, titles, kept = set(), set(), []
    for seq, key, host, title in sorted(rows):
        named = (host, title) if title is not None else None
        if (key is not None and key in keys) or (named is not None and named in titles):
            continue
        keys.add(key)
        if named is not None:
            titles.add(named)
        kept.append(seq)
    return kept


SCHEMA = "seq int, hostpath_surt string, host string, title string"


@pytest.mark.parametrize("seed,at_once", [(0, 0), (1, 40), (2, 50_000)])
def test_first_wins_against_brute_force(spark, seed, at_once, monkeypatch):
    monkeypatch.setattr(cp, "SETTLED_AT_ONCE", at_once)
    rng = random.Random(seed)
    rows = []
    for seq in rng.sample(range(1000), 250):
        host = "ab"[rng.random() < 0.7]
        title = None if rng.random() < 0.1 else f"t{rng.randint(0, 40)}"
        key = None if rng.random() < 0.1 else f"{host}/{rng.randint(0, 60)}"
        rows.append((seq, key, host, title))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = cp.first_wins(df, "seq")
    assert sorted(r.seq for r in got.collect()) == brute_first_wins(rows)
    assert got.columns == df.columns


def test_first_wins_chain_and_hot_title(spark):
    # 1 blocks 2 by key; 2 would block 3 by title but is itself out, and so on.
    chain = [(i, f"k{i // 2}", "h", f"t{(i + 1) // 2}") for i in range(30)]
    hot = [(100 + i, f"p{i}", "h", "Not found") for i in range(200)]
    rows = chain + hot
    got = cp.first_wins(spark.createDataFrame(rows, SCHEMA), "seq")
    kept = sorted(r.seq for r in got.collect())
    assert kept == brute_first_wins(rows)
    again = cp.first_wins(got, "seq")
    assert sorted(r.seq for r in again.collect()) == kept


def test_first_wins_long_chain_and_null_keys(spark):
    rows = [(i, f"k{i // 2}", "h", f"t{(i + 1) // 2}") for i in range(5000)] + [(9000, None, "h", None), (9001, None, "h", None), (9002, None, "h", "t1")]
    got = cp.first_wins(spark.createDataFrame(rows, SCHEMA), "seq")
    assert sorted(r.seq for r in got.collect()) == brute_first_wins(rows)


def test_new_articles_collide_with_each_other(spark):
    old = [(0, "a", "h", "t")]
    new = [(1, "b", "h", "u"), (2, "b", "h", "v"), (3, "c", "h", "u"), (4, "a", "h", "w"), (5, "d", "h", "t"), (6, "e", "h", None), (7, None, "h", "v")]
    got = cp.insert_articles(spark.createDataFrame(new, SCHEMA), spark.createDataFrame(old, SCHEMA), "seq")
    assert sorted(r.seq for r in got.collect()) == [s for s in brute_first_wins(old + new) if s]


def test_insert_absent_ignores_null_parts(spark):
    new = spark.createDataFrame([(1, "a", "h", "t"), (2, "b", "h", None), (3, "c", "h", "t"), (4, None, "h", "u")], SCHEMA)
    old = spark.createDataFrame([(9, "a", "h", None), (8, "z", "h", "t"), (7, None, "h", None)], SCHEMA)
    got = cp.insert_absent(new, old, [["hostpath_surt"], ["host", "title"]])
    assert sorted(r.seq for r in got.collect()) == [2, 4]


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 3, 2), ("a", 3, 3), ("b", 2, 4), (None, 5, 5), (None, 4, 6)], "k string, ts int, id int")
    one = cp.first_by(df, ["k"], ["ts", "id"], latest=True)
    assert sorted(r.id for r in one.collect()) == [3, 4, 5]
    assert sorted(r.id for r in cp.latest_ties(df, "k", "ts").collect()) == [2, 3, 4]


def doc(**over):
    base = {
        "language": {"best": {"value": "EN-us"}},
        "title": {"best": {"value": "The Storm"}},
        "description": {"best": {"value": None}},
        "timestamp.published": {"best": {"value": {"lo": "2020-05-06 07:08:09", "hi": "2020-05-07"}}},
        "content": {"best": {"value": {"html": "<p>x</p>", "text": "Rain, and wind."}}},
    }
    for key, value in over.items():
        key = key.replace("__", ".")
        if value == "drop":
            del base[key]
        else:
            base[key] = value
    return json.dumps(base)


def test_article_rules(spark):
    docs = {
        1: doc(), 2: doc(language="drop"), 3: doc(description="drop"), 4: doc(timestamp__published={"best": {"value": {"lo": None}}}),
        5: doc(timestamp__published={"best": {"value": {"lo": "soon"}}}), 6: doc(title={"best": None}),
        7: json.dumps({"exception": {"type": "E", "location": "x"}}), 8: doc(content={"best": {"value": {"html": "<p>", "text": None}}}),
    }
    df = spark.createDataFrame([(i, f"https://www.a.test/{i}/", d) for i, d in docs.items()], "id int, url string, j string")
    df = df.withColumn("doc", cp.typed_doc("j"))
    rows = {r.id: r for r in cp.article_candidates(df, stops={"EN": ["and"]}).collect()}
    assert {i: r.reject for i, r in rows.items()} == {
        1: None, 2: "language", 3: "description", 4: "timestamp.published", 5: "timestamp.published unreadable",
        6: "title", 7: "language", 8: "content text",
    }
    good = rows[1]
    assert (good.language, good.hostpath_surt, good.description) == ("en", "test,a)/1", None)
    assert [(t.pos, t.lexeme) for t in good.tsv_content] == [(1, "rain"), (3, "wind")]
    assert [r.id for r in cp.to_articles(df).collect()] == [1]


def test_summary_document(spark):
    text = '{"version":"1","process_time":2,"title":{"best":{"value":"T"}},"gone":{"best":null},"n":{"best":{"value":3}},"raw":[1],"s":"x","o":{"k":1}}'
    df = spark.createDataFrame([(text,)], "j string").select(F.parse_json("j").alias("v"))
    assert cp.summary_document(df, "v").first().summary == {"title": '"T"', "n": "3", "raw": "[1]", "s": '"x"', "o": '{"k":1}'}


def test_extract(spark):
    page = (
        "<HTML lang='fr'><head><title> A &amp; B\n C </title><meta name=\"description\" content=\"about\">"
        "<script>var t = '<p>no</p>';</script></head><body><a href=\"/x\">x</a><article><h1>Head</h1><!-- no -->"
        "<p>One&nbsp;two</p></article><a class=y href=\"https://b.test/z\">z</a></body></html>"
    )
    rows = [(1, page), (2, "plain words"), (3, None), (4, "<body>only <b>body</b></body>"), (5, "<" * 50)]
    got = {r.id: r for r in ex.extract_pages(spark.createDataFrame(rows, "id int, html string")).collect()}
    one = got[1]
    assert (one.title, one.description, one.language, one.content_text) == ("A & B C", "about", "fr", "Head One two")
    assert [x.href for x in one.links] == ["/x", "https://b.test/z"]
    assert one.error is None and got[2].error.type == "no markup" and got[3].error.type == "empty"
    assert got[4].content_text == "only body" and got[4].title is None


def test_resolve_href(spark):
    page = "https://a.test/dir/page.html?q=1#f"
    expected = {
        "https://b.test/x": "https://b.test/x", "//b.test/x": "https://b.test/x", "/x": "https://a.test/x", "x": "https://a.test/dir/x",
        "?z=2": "https://a.test/dir/page.html?z=2", "#g": "https://a.test/dir/page.html?q=1#g", "mailto:me@a.test": "mailto:me@a.test",
        "": "https://a.test/dir/page.html?q=1",
    }
    df = spark.createDataFrame([(h,) for h in expected], "h string")
    assert {r.h: r.x for r in df.select("h", links.resolve_href(F.lit(page), "h").alias("x")).collect()} == expected
    root = df.filter("h = 'x'").select(links.resolve_href(F.lit("https://a.test"), "h").alias("x")).first().x
    assert root == "https://a.test/x"


def test_weighted_inlinks(spark):
    edges = spark.createDataFrame([("s1", "d", 2, 2, 1), ("s2", "d", 4, 4, 4), ("s1", "e", 1, 1, 1)],
                                  "src string, dest string, src_url long, src_hostpathquery long, src_hostpath long")
    ranks = spark.createDataFrame([(2, "s1x.test"), (5, "S1X.test")], "rank int, host string")
    edges = edges.withColumn("src", F.when(F.col("src") == "s1", "test,s1x)").otherwise(F.col("src")))
    got = {r.dest: r for r in links.weighted_inlinks(edges, ranks).collect()}
    assert got["d"].src_url == pytest.approx(2 / 2 + 4 / 1e6) and got["d"].src_host == pytest.approx(0.5 + 1e-6)
    assert got["e"].src_hostpath == pytest.approx(0.5)


def test_page_views_prune_unread_parts(spark):
    df = spark.createDataFrame([(1, "https://a.test", doc())], "id int, url string, j string").withColumn("doc", cp.typed_doc("j"))
    plan = df.select(cp.best("doc", "language").alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan


def test_every_form_of_link(spark):
    html = """<a href='x'>1</a><a class=c href=y?a=1&amp;b=2>2</a><A HREF="z">3</A><meta content='d &lt; e' name="description"><meta property=article:published_time content=2020-01-02><link href="https://c.test/" rel=canonical>"""
    r = ex.extract_pages(spark.createDataFrame([(html,)], "html string")).first()
    assert [x.href for x in r.links] == ["x", "y?a=1&b=2", "z"]
    assert (r.description, r.published, r.canonical, r.author) == ("d < e", "2020-01-02", "https://c.test/", None)


def test_entities(spark):
    """Numbers in both bases, beyond 16 bits, of no character; an ampersand begins no new entity."""
    cases = {
        "caf&#233; &#xE9;&#XE9;": "caf\u00e9 \u00e9\u00e9",
        "&#128512;&#x1F600;": "\U0001f600\U0001f600",
        "&#0;&#xD800;&#1114112;": "\ufffd" * 3,
        "&#38;lt; &amp;#233; &#38;amp;": "&lt; &#233; &amp;",
        "a &# b &#; &#x; & c &#9999999999;": "a &# b &#; &#x; & c &#9999999999;",
        "&#39;&apos;&quot;&#60;b&#62;": "''\"<b>",
        "x&#160;y&nbsp;z": "x y z",
    }
    rows = [(i, f'<html><title>{t}</title><a href="/p?a=1&#38;b={i}">l</a></html>') for i, t in enumerate(cases)]
    got = {r.id: r for r in ex.extract_pages(spark.createDataFrame(rows, "id int, html string")).collect()}
    assert [got[i].title for i in sorted(got)] == list(cases.values())
    assert got[3].links[0].href == "/p?a=1&b=3"
