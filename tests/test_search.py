import math
import random

import pytest
from pyspark.sql import functions as F

from presstide.functions import text as tx
from presstide.operators import search as se
from presstide.operators import textrollups as tr
from presstide.operators import trends as td


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        words = [rng.choice(["rain", "wind", "sun", "fog", "ice"]) for _ in range(rng.randint(0, 12))]
        host = rng.choice(["www.a.test", "b.test", "news.b.test"])
        rows.append((i, f"https://{host}/p{i}", "en" if i % 5 else "fr", f"2020-{i % 12 + 1:02d}-{i % 28 + 1:02d} 10:00:00", " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def articles(spark, corpus):
    from presstide.functions import urlkeys as uk
    from presstide.session import persist_table

    df = spark.createDataFrame(corpus, "id int, url string, language string, t string, content string")
    df = df.withColumns({
        "timestamp_published": F.col("t").cast("timestamp"), "hostpath_surt": uk.url_hostpath_surt("url"), "title": F.lit("rain"),
    })
    df = tx.with_tokens(tx.with_tokens(df, "content", "language", "tsv_content", stops={}), "title", "language", "tsv_title", stops={})
    df = df.withColumns({"doc_len": F.size("tsv_content"), "tokens": F.col("tsv_content")})
    return persist_table(df, "test-articles")


@pytest.fixture(scope="module")
def index(spark, articles):
    from presstide.session import scratch_dir

    return se.write_index(se.build_index(articles), scratch_dir(spark, "test-index"), 5)


def ids(df):
    return sorted(r.doc for r in df.collect())


def where(corpus, test):
    return [r[0] for r in corpus if test(r[4].split())]


def has_run(words, run):
    return any(words[i : i + len(run)] == run for i in range(len(words)))


def test_boolean_parts(corpus, articles, index):
    assert ids(se.docs_with_all(index, ["rain", "wind", "rain"])) == where(corpus, lambda w: {"rain", "wind"} <= set(w))
    assert ids(se.docs_with_any(index, ["fog", "ice"])) == where(corpus, lambda w: {"fog", "ice"} & set(w))
    got = se.match(index, all_of=["rain"], any_of=["sun", "fog"], none_of=["ice"])
    assert ids(got) == where(corpus, lambda w: "rain" in w and {"sun", "fog"} & set(w) and "ice" not in w)
    every = articles.select(F.col("id").alias("doc"))
    # Documents without a word are found too.
    assert ids(se.match(index, none_of=["ice"], every=every)) == where(corpus, lambda w: "ice" not in w)
    with pytest.raises(ValueError):
        se.match(index, none_of=["ice"])
    assert se.match(index) is None


@pytest.mark.parametrize("run", [["rain", "wind"], ["rain", "rain"], ["wind", "rain", "wind"], ["sun"], ["none", "rain"]])
def test_phrases_against_brute_force(corpus, index, run):
    docs = se.match(index, phrases=[run])
    assert ids(docs) == where(corpus, lambda w: has_run(w, run))


def test_long_phrase(spark):
    words = [f"w{i % 90}" for i in range(100)]
    rows = [(1, [(i + 1, w) for i, w in enumerate(["x", *words])]), (2, [(i + 1, w) for i, w in enumerate(words[:99])])]
    vectors = spark.createDataFrame(rows, "id int, tsv_content array<struct<pos:int,lexeme:string>>")
    assert ids(se.match(se.build_index(vectors), phrases=[words])) == [1]


def test_long_site_term(spark):
    site = "a" * 5000 + ".test"
    got = se.parse_queries(spark.createDataFrame([(1, f"site:{site}")], "q int, query string")).first()
    assert got.term == site


def test_bm25_by_hand(corpus, articles, index):
    got = {r.doc: r.score for r in se.bm25(index, se.corpus_stats(articles), ["rain", "fog"]).collect()}
    docs = {r[0]: r[4].split() for r in corpus}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    for i, words in docs.items():
        score = 0.0
        for term in ("rain", "fog"):
            tf, df = words.count(term), sum(term in w for w in docs.values())
            if tf:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                score += idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(words) / mean))
        assert got.get(i, 0.0) == pytest.approx(score)


def test_search_orders_sites_and_pages(corpus, articles, index):
    hits = se.search(articles, index, sites=["a.test"], orderby="time_desc", k=5).collect()
    mine = [r for r in corpus if "www.a.test" in r[1]]
    assert [h.id for h in hits] == [r[0] for r in sorted(mine, key=lambda r: (r[3], -r[0]), reverse=True)[:5]]
    assert {h.host for h in hits} == {"a.test"} and hits[0]["rank"] is None
    asc = se.search(articles, index, sites=["b.test", "a.test"], orderby="time_asc", k=3, offset=2).collect()
    two = sorted((r for r in corpus if "news" not in r[1]), key=lambda r: (r[3], r[0]))
    assert [h.id for h in asc] == [r[0] for r in two[2:5]]
    ranked = se.search(articles, index, all_of=["fog"], orderby="rank", k=200).collect()
    assert [h["rank"] for h in ranked] == sorted(h["rank"] for h in ranked)
    assert len(ranked) == len(where(corpus, lambda w: "fog" in w))
    none = se.search(articles, index, lo="2020-03-01", hi="2020-04-01", k=500).collect()
    assert {h.id for h in none} == {r[0] for r in corpus if r[3].startswith("2020-03")}
    with pytest.raises(ValueError):
        se.search(articles, index, orderby="best")


def test_parse_queries(spark):
    df = spark.createDataFrame([(1, 'Storm "High Water" site:A.test rain'), (2, '   '), (3, '"open end')], "q int, query string")
    got = [(r.q, r.kind, r.term) for r in se.parse_queries(df).orderBy("q", "ord").collect()]
    assert got == [
        (1, "word", "storm"), (1, "phrase", "high water"), (1, "site", "a.test"), (1, "word", "rain"), (3, "word", "open"), (3, "word", "end"),
    ]


def test_subsets(spark):
    df = spark.createDataFrame([(1, ["a", "b c", "d"]), (2, ["only"]), (3, [])], "query_id int, terms array<string>")
    got = sorted((r.n_terms, r.subset) for r in td.term_subsets(df).collect())
    assert got == [(1, '"b c"'), (1, "a"), (1, "d"), (2, '"b c" d'), (2, 'a "b c"'), (2, "a d")]
    long = spark.createDataFrame([(1, list("abcdefghijklmnopq"))], "query_id int, terms array<string>")
    out = td.term_subsets(long)
    assert out.count() == out.distinct().count() == 2**17 - 2


# Trends ----------------------------------------------------------------------

def test_calendars(spark):
    assert td.calendar(spark, "1980-01-01", "2022-01-01").count() == 505
    assert td.calendar(spark, "2000-01-01", "2020-12-31").count() == 252
    with pytest.raises(Exception, match="calendar too long"):
        td.calendar(spark, "0001-01-01", "9999-01-01", "day").collect()


@pytest.fixture(scope="module")
def rollups(articles):
    from presstide.session import persist_table

    return (
        persist_table(tr.text_rollup(articles, "month"), "total"),
        persist_table(tr.text_rollup(articles, "month", terms=True, sketch=True), "terms"),
        persist_table(tr.text_rollup(articles, "month", terms=True), "counts"),
    )


LO, HI = "2019-12-01", "2021-02-01"


def test_trend_counts_and_order(corpus, rollups):
    total, terms, _ = rollups
    both = {str(r.time)[:7]: r for r in td.trend(total, terms, ["rain", "fog"], "en", LO, HI).collect()}
    one = {str(r.time)[:7]: r for r in td.trend(total, terms, ["rain"], "en", LO, HI).collect()}
    assert len(both) == 15
    for month, r in both.items():
        docs = [c[4].split() for c in corpus if c[2] == "en" and c[3].startswith(month)]
        assert r.total == len(docs)
        assert r.estimate == r.lower == r.upper == sum({"rain", "fog"} <= set(w) for w in docs)
        assert r.estimate <= one[month].estimate == sum("rain" in w for w in docs)


def test_trend_normalised(rollups):
    total, terms, _ = rollups
    for r in td.trend(total, terms, ["rain"], "en", LO, HI, "total").collect():
        assert 0 <= r.estimate <= 1
    for r in td.trend(total, terms, ["rain"], "en", LO, HI, ["rain"]).collect():
        assert r.estimate == pytest.approx(1.0) or r.estimate == 0
    for r in td.trend(total, terms, [], "en", LO, HI).collect():
        assert r.estimate == r.total


def test_ratios(corpus, rollups):
    total, _, counts = rollups
    rows = td.ratio_series(total, counts, ["rain", "absent"], "en", "2020-01-01", "2020-12-31").collect()
    assert len(rows) == 12 and all(r.y1 == 0 for r in rows)
    docs = [c[4].split() for c in corpus if c[2] == "en" and c[3].startswith("2020-01")]
    assert rows[0].y0 == pytest.approx(sum("rain" in w for w in docs) / len(docs))


def test_family_matches_single_rollups(articles, rollups):
    total, _, _ = rollups
    both = tr.text_rollup_family(articles, "month")
    a = both.filter("NOT by_host").select("language", "timestamp_published_month", "docs")
    b = total.select("language", "timestamp_published_month", F.col("hostpath_surt").alias("docs"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_term_filter_reaches_the_scan(rollups):
    _, terms, _ = rollups
    plan = td.term_sketches(terms, ["rain"], "en", LO, HI)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters:")[1]
    assert "alltext" in pushed and "language" in pushed and "timestamp_published_month" in pushed
