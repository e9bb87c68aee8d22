"""URL keys, scalar functions, filters and projections over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import sqlfuncs
from ..functions import urlkeys as uk
from ..operators import captures as cp
from ..operators import extract as ex
from . import duck as d
from .registry import query
from .testbed import Tables


def _url_query(name, out, column, sql):
    @query(name, f"SELECT page_id, {sql} AS {out} FROM ({d.PAGES})")
    def run(t: Tables):
        return t.read("pages").select("page_id", column("url").alias(out))


_url_query("url01_remove_scheme", "bare", uk.url_remove_scheme,
           d.bare("url"))
_url_query("url02_host", "h", uk.url_host, "host")
_url_query("url03_path", "p", lambda u: uk.url_path(F.lower(u)), "_p0")
_url_query("url04_query", "q", lambda u: uk.url_query(F.lower(u)), "_q0")
_url_query("url05_host_simplify", "h", lambda u: uk.host_simplify(uk.url_host(F.lower(u))), "_h")
_url_query("url06_host_surt", "s", lambda u: uk.host_surt(uk.host_simplify(uk.url_host(F.lower(u)))), "_s")
_url_query("url07_host_unsurt", "h", lambda u: uk.host_unsurt(uk.url_host_surt(u)), "_h")
_url_query("url08_unsurt", "u", lambda u: uk.unsurt(uk.url_hostpathquery_surt(u)),
           f"{d.unsurt_host('hostpathquery_surt')} || split_part(hostpathquery_surt, ')', 2)")
_url_query("url09_path_simplify", "p", lambda u: uk.path_simplify(uk.url_path(F.lower(u))), "_p")
_url_query("url10_query_simplify", "q", lambda u: uk.query_simplify(uk.url_query(F.lower(u))), "_q")
_url_query("url11_host_key", "k", uk.url_host_surt, "host_surt")
_url_query("url12_hostpath_key", "k", uk.url_hostpath_surt, "hostpath_surt")
_url_query("url13_hostpathquery_key", "k", uk.url_hostpathquery_surt, "hostpathquery_surt")
_url_query("url15_index_hostpath", "k", uk.index_hostpath, d.HOSTPATH)


@query("url14_key_truncate", "SELECT page_id, length(left(html, 2048)) AS n FROM pages")
def url14(t: Tables):
    return t.read("pages").select("page_id", F.length(uk.key_truncate("html")).cast("bigint").alias("n"))


@query("scl01_array_reverse", "SELECT page_id, array_to_string(list_reverse(string_split(url, '/')), '/') AS r FROM pages")
def scl01(t: Tables):
    return t.read("pages").select("page_id", F.array_join(sc.array_reverse(F.split("url", "/")), "/").alias("r"))


@query("scl02_array_uniq", "SELECT doc_id, len(list_distinct(string_split(text, ' '))) AS n FROM documents")
def scl02(t: Tables):
    return t.read("documents").select("doc_id", F.size(sc.array_uniq(F.split("text", " "))).cast("bigint").alias("n"))


_LANG_TEXTS = "CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN upper(lang) || '   ' WHEN 2 THEN '\"' || lang || '\"' WHEN 3 THEN lang || '_XX' WHEN 4 THEN lang || 'x-us' ELSE lang || 'xxlish' END"


@query("scl03_language_iso639", f"SELECT doc_id, {d.language('x')} AS code FROM (SELECT doc_id, {_LANG_TEXTS} AS x FROM documents)")
def scl03(t: Tables):
    return t.read("documents").select("doc_id", sc.language_iso639(F.expr(_LANG_TEXTS.replace("'\"'", "'\\\"'"))).alias("code"))


@query(
    "scl04_language_lookup",
    f"""WITH x AS (SELECT doc_id, lower(trim({_LANG_TEXTS}, '" ')) AS c FROM documents),
    k AS (SELECT doc_id, c, length(c) = 2 OR substr(c, 3, 1) IN (':', '_', '-', ' ') AS two,
          length(c) = 3 OR substr(c, 4, 1) IN (':', '_', '-', ' ') AS three FROM x)
    SELECT doc_id, CASE WHEN two THEN left(c, 2) || '3' WHEN three THEN left(c, 3)
      WHEN c IN (SELECT DISTINCT lang || 'xxlish' FROM documents) THEN left(c, 2) || '3' ELSE 'invalid' END AS part3 FROM k""",
)
def scl04(t: Tables):
    docs = t.read("documents")
    codes = docs.select("lang").distinct().select(
        F.col("lang").alias("part1"),
        F.concat("lang", F.lit("3")).alias("part3"),
        F.concat("lang", F.lit("xxLish")).alias("ref_name"),
    )
    texts = docs.select("doc_id", F.expr(_LANG_TEXTS.replace("'\"'", "'\\\"'")).alias("x"))
    return sc.lookup_language(texts, "x", codes).select("doc_id", "part3")


@query(
    "scl05_time_trunc",
    "SELECT event_id, date_trunc('hour', ts) AS h, CAST(date_trunc('day', ts) AS TIMESTAMP) AS dd, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m FROM events",
)
def scl05(t: Tables):
    return t.events().select("event_id", sc.hour_of("ts").alias("h"), sc.day_of("ts").alias("dd"), sc.month_of("ts").alias("m"))


@query("scl06_date", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d FROM events")
def scl06(t: Tables):
    return t.events().select("event_id", F.to_date("ts").cast("string").alias("d"))


@query("scl07_epoch", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS x FROM events")
def scl07(t: Tables):
    return t.events().select("event_id", sc.epoch("ts").alias("x"))


@query(
    "scl08_parse_time",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END AS ts FROM orders",
)
def scl08(t: Tables):
    text = F.when(F.col("o_orderstatus") == "F", "some day").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return t.read("orders").select("o_orderkey", sc.parse_time(text).alias("ts"))


@query(
    "scl09_text_builtins",
    """SELECT page_id, split_part(url, '/', 3) AS part, length(url) AS n, lower(url) AS low, coalesce(nullif(url, ''), '-') AS c,
       array_to_string(string_to_array(url, '/'), '|') AS joined, url ILIKE '%BLOG%' AS blog, round(pow(length(url), 1.5) / 2, 6) AS score
       FROM pages""",
)
def scl09(t: Tables):
    return t.read("pages").select(
        "page_id",
        F.split_part("url", F.lit("/"), F.lit(3)).alias("part"),
        F.length("url").cast("bigint").alias("n"),
        F.lower("url").alias("low"),
        F.coalesce(F.nullif("url", F.lit("")), F.lit("-")).alias("c"),
        F.array_join(F.split("url", "/"), "|").alias("joined"),
        F.col("url").ilike("%BLOG%").alias("blog"),
        F.round(F.pow(F.length("url").cast("double"), F.lit(1.5)) / 2, 6).alias("score"),
    )


@query(
    "scl10_time_distance",
    "SELECT event_id, CAST(floor(epoch(ts)) - epoch(TIMESTAMP '1000-01-01') AS BIGINT) AS s FROM events",
)
def scl10(t: Tables):
    return t.events().select("event_id", sc.seconds_from("ts").alias("s"))


@query("scl11_named_fields", "SELECT lang, min(n_chars) AS lo, round(avg(n_chars), 6) AS mid, max(n_chars) AS hi FROM documents GROUP BY lang")
def scl11(t: Tables):
    """Fields of a struct by name, where an array was indexed by number."""
    span = F.struct(F.min("n_chars").alias("lo"), F.avg("n_chars").alias("mid"), F.max("n_chars").alias("hi"))
    return t.read("documents").groupBy("lang").agg(span.alias("s")).select("lang", "s.lo", F.round("s.mid", 6).alias("mid"), "s.hi")


@query("udx1_sql_functions", f"SELECT page_id, host_surt, hostpath_surt, hostpathquery_surt FROM ({d.PAGES})")
def udx1(t: Tables):
    """The same keys through functions registered for SQL text."""
    sqlfuncs.register(t.spark)
    t.read("pages").createOrReplaceTempView("udx1_pages")
    return t.spark.sql(
        "SELECT page_id, url_host_surt(url) AS host_surt, url_hostpath_surt(url) AS hostpath_surt, "
        "url_hostpathquery_surt(url) AS hostpathquery_surt FROM udx1_pages"
    )


@query("udx2_sql_aggregates", f"SELECT host, count(DISTINCT url) AS url, true AS hll_ok FROM ({d.PAGES}) GROUP BY host")
def udx2(t: Tables):
    """Both sketch aggregates from SQL text."""
    sqlfuncs.register(t.spark)
    t.read("pages").createOrReplaceTempView("udx2_pages")
    return t.spark.sql(
        "SELECT host, url, abs(h - url) <= 1 + 0.05 * url AS hll_ok FROM (SELECT url_host(url) AS host, "
        "theta_sketch_estimate(theta_sketch_agg(url, 12)) AS url, hll_sketch_estimate(hll_sketch_agg(url, 12)) AS h "
        "FROM udx2_pages GROUP BY url_host(url))"
    )


@query(
    "udx3_table_functions",
    f"SELECT page_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1) AS l FROM pages)",
)
def udx3(t: Tables):
    return t.read("pages").select("page_id", F.posexplode(ex.page_links("html")).alias("i", "x")).select(
        "page_id", F.col("i").cast("bigint").alias("i"), F.col("x.href").alias("href")
    )


# Filters ---------------------------------------------------------------------

_KEYWORDS = ["news", "blog", "article", "archive"]


def url_keyword(col="url"):
    """Case-insensitive: the address mentions any of the four words."""
    out = None
    for word in _KEYWORDS:
        one = F.col(col).ilike(f"%{word}%")
        out = one if out is None else out | one
    return out


_KEYWORD_SQL = " OR ".join(f"url ILIKE '%{w}%'" for w in _KEYWORDS)


@query("flt07_url_keywords", f"SELECT page_id, url FROM pages WHERE {_KEYWORD_SQL}")
def flt07(t: Tables):
    return t.read("pages").select("page_id", "url").filter(url_keyword())


@query("flt08_time_half_open", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01'")
def flt08(t: Tables):
    return t.read("orders").filter(sc.time_in("o_orderdate", "1996-01-01", "1997-01-01")).select("o_orderkey")


@query("flt09_time_closed", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1997-01-01'")
def flt09(t: Tables):
    return t.read("orders").filter(sc.time_in("o_orderdate", "1996-01-01", "1997-01-01", closed=True)).select("o_orderkey")


@query("flt10_language", "SELECT doc_id FROM documents WHERE lang = 'de'")
def flt10(t: Tables):
    return t.read("documents").filter("lang = 'de'").select("doc_id")


@query("flt12_host_suffix", f"SELECT page_id FROM ({d.PAGES}) WHERE host LIKE '%' || 'example.org'")
def flt12(t: Tables):
    return t.read("pages").filter(uk.url_host("url").endswith("example.org")).select("page_id")


@query("flt14_not_banned", f"SELECT url FROM ({d.LISTED}) WHERE coalesce(priority, '') <> 'ban'")
def flt14(t: Tables):
    from ..operators import lists

    return t.listed().filter(lists.not_banned()).select("url")


@query("flt15_type_article", f"SELECT id, title FROM (SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t0, trim(replace(regexp_replace(t0, '\\s+', ' ', 'g'), '&amp;', '&')) AS title FROM ({d.CAPTURES})) WHERE type = 'article'")
def flt15(t: Tables):
    return t.captures().filter(cp.best("doc", "type") == "article").select("id", cp.best("doc", "title").alias("title"))


@query("flt17_key_prefix", f"SELECT page_id, hostpathquery_surt FROM ({d.PAGES}) WHERE hostpathquery_surt LIKE 'com,example,th%'")
def flt17(t: Tables):
    keyed = t.read("pages").select("page_id", uk.url_hostpathquery_surt("url").alias("hostpathquery_surt"))
    return keyed.filter(F.col("hostpathquery_surt").startswith("com,example,th"))


# Projections -----------------------------------------------------------------

@query(
    "prj1_json_paths",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events",
)
def prj1(t: Tables):
    v = F.parse_json("props")
    return t.read("events").select(
        "event_id",
        F.variant_get(v, "$.k", "bigint").alias("k"),
        F.try_variant_get(v, "$['timestamp.published'].best.value.lo", "string").alias("missing"),
    )


@query("prj2_computed_keys", "SELECT date_trunc('hour', ts) AS access_hour, count(*) AS n FROM events GROUP BY 1")
def prj2(t: Tables):
    return t.events().withColumn("access_hour", sc.hour_of("ts")).groupBy("access_hour").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj3_summary_document",
    """SELECT event_id, key, value FROM (
      SELECT event_id, 'language' AS key, '"en"' AS value FROM events
      UNION ALL SELECT event_id, 'kind', '"' || event_type || '"' FROM events
      UNION ALL SELECT event_id, 'k', json_extract_string(props, '$.k') FROM events
      UNION ALL SELECT event_id, 'list', '[1,2]' FROM events)""",
)
def prj3(t: Tables):
    doc = F.concat(
        F.lit('{"version":"9","process_time":1,"gone":{"best":null},"list":[1,2],"language":{"best":{"value":"en"}},"kind":"'),
        F.col("event_type"), F.lit('","k":{"best":{"value":'), F.get_json_object("props", "$.k"), F.lit("}}}"),
    )
    docs = t.read("events").select("event_id", F.parse_json(doc).alias("doc"))
    return cp.summary_document(docs, "doc").select("event_id", F.explode("summary"))


@query(
    "prj4_display_fields",
    f"""SELECT id, accessed_at, url, '' AS author, coalesce(strftime(published_lo, '%Y-%m-%d %H:%M:%S') || '/' || strftime(published_lo + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S'), '') AS "timestamp.published",
      coalesce(strftime(modified, '%Y-%m-%d %H:%M:%S'), '') AS "timestamp.modified",
      CASE WHEN event_type <> 'error' THEN url ELSE '' END AS "url.canonical", coalesce(language, '') AS language, '' AS version
      FROM ({d.CAPTURES})""",
)
def prj4(t: Tables):
    return cp.display_fields(t.captures())


# Text of the article element, in check SQL.
ARTICLE_BODY = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1),
        '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&copy;', '©', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(
    "prj5_article_projection",
    f"""SELECT id, url, hostpath_surt, language, published_lo AS timestamp_published, title, description,
        len({d.words('title')}) AS title_words, len({d.words('body')}) AS content_words FROM (
      SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t0,
        trim(replace(regexp_replace(t0, '\\s+', ' ', 'g'), '&amp;', '&')) AS title, CAST(NULL AS VARCHAR) AS description, {ARTICLE_BODY} AS body
      FROM ({d.CAPTURES})) WHERE event_type <> 'error' AND language IS NOT NULL AND title <> '' AND body <> ''""",
)
def prj5(t: Tables):
    arts = cp.to_articles(t.stored_captures(), stops={})
    return arts.select(
        "id", "url", "hostpath_surt", "language", "timestamp_published", "title", "description",
        F.size("tsv_title").cast("bigint").alias("title_words"), F.size("tsv_content").cast("bigint").alias("content_words"),
    )


@query(
    "flt06_article_rejects",
    f"SELECT CASE WHEN language IS NULL THEN 'language' ELSE 'article' END AS reason, count(*) AS n FROM ({d.CAPTURES}) GROUP BY 1",
)
def flt06(t: Tables):
    rows = cp.article_candidates(t.stored_captures(), stops={})
    return rows.groupBy(F.coalesce("reject", F.lit("article")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("flt05_drop_invalid", "SELECT page_id, url FROM pages WHERE url NOT LIKE '%#top' AND html IS NOT NULL")
def flt05(t: Tables):
    rows = t.read("pages").withColumn("accessed_at", F.when(~F.col("url").endswith("#top"), F.lit("2024-01-01")))
    return cp.drop_invalid(rows).select("page_id", "url")


@query(
    "ext1_extract_pages",
    r"""SELECT page_id, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS language,
      trim(replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g'), '&amp;', '&')) AS title,
      len(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS n_links,
      length(""" + ARTICLE_BODY + r""") AS text_chars,
      CAST(NULL AS VARCHAR) AS error FROM pages""",
)
def ext1(t: Tables):
    p = ex.extract_pages(t.read("pages"))
    return p.select(
        "page_id", "language", "title",
        F.size("links").cast("bigint").alias("n_links"),
        F.length("content_text").cast("bigint").alias("text_chars"),
        F.col("error.type").alias("error"),
    )


@query(
    "qlt2_parse_failures",
    f"SELECT exception_type AS type, exception_location AS location, count(*) AS n FROM ({d.CAPTURES}) WHERE exception_type IS NOT NULL GROUP BY ALL",
)
def qlt2(t: Tables):
    facts = cp.capture_facts(t.captures()).filter("exception_type IS NOT NULL")
    return facts.groupBy(F.col("exception_type").alias("type"), F.col("exception_location").alias("location")).agg(F.count(F.lit(1)).alias("n"))
