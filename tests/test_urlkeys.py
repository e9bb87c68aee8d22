import pytest
from pyspark.sql import functions as F

from presstide.functions import sqlfuncs
from presstide.functions import urlkeys as uk

LONG = "https://www.daily.test/2021/03/04/city/storm-hits-coast/index.html"

PAIRS = [
    (uk.url_remove_scheme, [
        ("https://paper.test", "paper.test"), ("https://paper.test/", "paper.test/"), (LONG, LONG[8:]),
        ("paper.test/a", "paper.test/a"), ("//paper.test/a", "paper.test/a"), ("paper.test/a//b", "b"),
        ("file:///etc", "/etc"), ("", ""), (None, None),
    ]),
    (uk.url_host, [
        ("https://paper.test", "paper.test"), ("paper.test:8080/x", "paper.test"), ("http://paper.test?q=1", "paper.test"),
        (LONG, "www.daily.test"), ("mailto:me@paper.test", "mailto"), ("https://paper.test#top", "paper.test#top"),
        ("/only/path", ""), (None, None),
    ]),
    (uk.url_path, [
        ("https://paper.test", "/"), ("https://paper.test/", "/"), (LONG, "/2021/03/04/city/storm-hits-coast/index.html"),
        ("paper.test/a/b?x=1", "/a/b"), ("paper.test/a/b;v=2?x=1", "/a/b"), ("paper.test/a/b#end", "/a/b"),
        ("paper.test/?x=1", "/"), ("paper.test/;v", "/"), ("paper.test?x=/y/z", "/y/z"), ("", "/"), (None, None),
    ]),
    (uk.url_query, [
        ("paper.test/a?x=1&y=2", "x=1&y=2"), ("paper.test/a?x=1#end", "x=1"), ("paper.test/a", ""), ("/a?x=1?y", "x=1"),
        ("", ""), (None, None),
    ]),
    (uk.host_simplify, [
        ("paper.test", "paper.test"), ("www.paper.test", "paper.test"), ("www12.paper.test", "paper.test"),
        ("m.paper.test", "paper.test"), ("mm.paper.test", "mm.paper.test"), ("www.m.paper.test", "m.paper.test"),
        ("wwwpaper.test", "wwwpaper.test"), (None, None),
    ]),
    (uk.host_surt, [("paper.test", "test,paper)"), ("a.b.co.test", "test,co,b,a)"), ("", ")"), (None, None)]),
    (uk.host_unsurt, [("test,paper)", "paper.test"), ("test,co,b,a)", "a.b.co.test"), (")", ""), (None, None)]),
    (uk.unsurt, [
        ("test,paper)", "paper.test"), ("test,paper,a)/x/y?z=1&w=2", "a.paper.test/x/y?z=1&w=2"),
        ("test,paper)/x(1)/y", "paper.test/x(1"), (None, None),
    ]),
    (uk.path_simplify, [
        ("/a/index.html/b", "/a/index.html/b"), ("/a/index.html", "/a"), ("/a/index.php", "/a"), ("/a/index.jsonx", "/a/index.jsonx"),
        ("/a/", "/a"), ("/a//", "/a/"), ("/index.htm", ""), ("/", ""), ("", ""), ("/a/indexZhtml", "/a"), (None, None),
    ]),
    (uk.query_simplify, [
        ("b=1&a=2", "a=2&b=1"), ("a=1&utm_source=x&b=2", "a=1&b=2"), ("utm_a=1", ""), ("utm=1", ""), ("", ""),
        ("z&&a", "&a&z"), (None, None),
    ]),
    (uk.url_host_surt, [
        ("https://WWW.Paper.test/A?b", "test,paper)"), ("paper.test", "test,paper)"), ("https://m.paper.test:80/", "test,paper)"),
        (None, None),
    ]),
    (uk.url_hostpath_surt, [
        ("https://paper.test/A/B/?q=1#x", "test,paper)/a/b"), ("https://paper.test/index.html", "test,paper)"),
        ("paper.test", "test,paper)"), (None, None),
    ]),
    (uk.url_hostpathquery_surt, [
        ("https://paper.test/A/?Q=1&utm_id=3&b=2", "test,paper)/a?b=2&q=1"), ("https://paper.test/?utm_id=3", "test,paper)"),
        ("https://paper.test/a?", "test,paper)/a"), (None, None),
    ]),
    (uk.key_truncate, [("x" * 3000, "x" * 2048), ("short", "short"), (None, None)]),
    (uk.index_hostpath, [
        ("https://User@Paper.test:8080/A;b/c;d?x#y", "paper.test/A;b/c"), ("http://paper.test", "paper.test"),
        ("no scheme", "no scheme"), (None, None),
    ]),
]


@pytest.mark.parametrize("fn,pairs", PAIRS, ids=[f.__name__ for f, _ in PAIRS])
def test_pairs(spark, fn, pairs):
    rows = spark.createDataFrame(pairs, "given string, expected string").withColumn("got", fn("given")).collect()
    assert [(r.given, r.got) for r in rows] == [(r.given, r.expected) for r in rows]


STRANGE = [
    "", " ", "?", "#", "//", "///", "://", "http://", "http://?", "a?b?c", "a#b?c", "http://[::1]:80/x", "ÜBER.test/ñ",
    "http://paper.test/\n/x", "\t", "javascript:alert(1)", "paper.test/%zz", "'; DROP TABLE x; --", "\\\\server\\share",
    "ＦＵＬＬ．test/ｗ", "😀.test/😀?😀=😀", "a" * 5000, "http://paper.test//", "paper.test/)x)y", "‮rtl.test", "\x00nul",
]


def test_sql_functions_agree_with_columns(spark):
    sqlfuncs.register(spark)
    df = spark.createDataFrame([(s,) for s in STRANGE + [LONG, None]], "u string")
    df.createOrReplaceTempView("strange")
    names = ["url_remove_scheme", "url_host", "url_path", "url_query", "host_simplify", "host_surt", "host_unsurt", "unsurt",
             "path_simplify", "query_simplify", "url_host_surt", "url_hostpath_surt", "url_hostpathquery_surt"]
    by_sql = spark.sql("SELECT " + ", ".join(f"{n}(u) AS {n}" for n in names) + " FROM strange").collect()
    by_col = df.select(*[getattr(uk, n)("u").alias(n) for n in names]).collect()
    assert by_sql == by_col


def test_language_function_agrees(spark):
    from presstide.functions import scalars as sc

    sqlfuncs.register(spark)
    texts = ["en", "EN   ", "en_us", "eng-us", '"fr"', "english", "", None, "de:", "\n pt \t", "x"]
    df = spark.createDataFrame([(s,) for s in texts], "l string")
    df.createOrReplaceTempView("langs")
    expected = ["en", "en", "en", "eng", "fr", "invalid", "", None, "de", "pt", "x"]
    assert [r.c for r in df.select(sc.language_iso639("l").alias("c")).collect()] == expected
    assert [r.c for r in spark.sql("SELECT language_iso639(l) AS c FROM langs").collect()] == expected


def test_round_trip(spark):
    hosts = ["paper.test", "a.b.co.test", "x"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert [r.r for r in df.select(uk.host_unsurt(uk.host_surt("h")).alias("r")).collect()] == hosts


def test_keys_need_no_python(spark):
    df = uk.with_url_keys(spark.createDataFrame([(LONG,)], "url string"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.first().hostpath_surt == "test,daily)/2021/03/04/city/storm-hits-coast"


def test_array_helpers(spark):
    from presstide.functions import scalars as sc

    rows = [([],), ([4, 4],), ([3, 1, 3],), ([None, None],), (None,)]
    df = spark.createDataFrame(rows, "a array<int>")
    got = df.select(sc.array_uniq("a").alias("u"), sc.array_reverse("a").alias("r")).collect()
    assert [r.u for r in got] == [[], [4], [3, 1], [None], None]
    assert [r.r for r in got] == [[], [4, 4], [3, 1, 3], [None, None], None]


def test_language_lookup(spark):
    from presstide.functions import scalars as sc

    iso = spark.createDataFrame(
        [("en", "eng", "English"), (None, "arc", "Official Aramaic"), ("de", "deu", "German")],
        "part1 string, part3 string, ref_name string",
    )
    df = spark.createDataFrame([("EN",), ("en-us",), ("deu_AT",), ("official aramaic",), ("klingon",), (None,)], "l string")
    got = {r.l: r.part3 for r in sc.lookup_language(df, "l", iso).collect()}
    assert got == {"EN": "eng", "en-us": "eng", "deu_AT": "deu", "official aramaic": "arc", "klingon": "invalid", None: None}


def test_time_helpers(spark):
    from presstide.functions import scalars as sc

    df = spark.createDataFrame([("2020-02-29 13:14:15",), ("never",)], "t string").select(sc.parse_time("t").alias("t"))
    rows = df.select("t", sc.epoch("t").alias("e"), F.date_format(sc.month_of("t"), "yyyy-MM-dd").alias("m")).collect()
    assert rows[0].e == 1582982055 and rows[0].m == "2020-02-01"
    assert rows[1].t is None and rows[1].e is None
