"""Crawl indexes, archives, ledgers, deduplication, lists, audits and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import text as tx
from ..functions import urlkeys as uk
from ..operators import captures as cp
from ..operators import extract as ex
from ..operators import ledger, lists
from ..operators import quality as qa
from ..operators import rollups as ru
from ..session import persist_table, scratch_dir
from ..sources import crawlindex as ci
from ..sources import records as rc
from ..sources import tables as tb
from ..streaming import jobs
from . import duck as d
from .q_rollups import capture_spec, capture_sql
from .registry import query
from .testbed import Tables

PREFIX = "com,example,th"


# Delimited and JSON files ----------------------------------------------------

@query("src01_delimited", f"SELECT url, type, CAST(bias AS INTEGER) AS bias FROM ({d.LISTED})")
def src01(t: Tables):
    """Tab-separated with a header, written and loaded with a column subset."""
    path = scratch_dir(t.spark, "tsv")
    t.listed().write.option("sep", "\t").option("header", True).csv(path)
    schema = "url string, hostname string, type string, priority string, bias int"
    return tb.read_delimited(t.spark, path, schema, "\t", ["url", "type", "bias"])


@query("src02_json_lines", "SELECT url, CAST(length(html) AS BIGINT) AS n FROM pages")
def src02(t: Tables):
    path = scratch_dir(t.spark, "jsonl")
    t.read("pages").select(F.to_json(F.struct("url", "html")).alias("value")).write.text(path)
    docs = tb.read_json_docs(t.spark, path)
    return docs.select(
        F.variant_get("doc", "$.url", "string").alias("url"),
        F.length(F.variant_get("doc", "$.html", "string")).cast("bigint").alias("n"),
    )


@query("src04_catalogue", f"SELECT DISTINCT crawl AS id FROM ({d.CRAWL_INDEX})")
def src04(t: Tables):
    """One JSON array of crawls; there are as many as months of crawling."""
    path = scratch_dir(t.spark, "catalogue")
    crawls = t.crawl_index().select(F.col("crawl").alias("id")).distinct()
    crawls.agg(F.to_json(F.collect_set(F.struct("id"))).alias("value")).write.text(path)
    return tb.read_catalogue(t.spark, path)


# Crawl index -----------------------------------------------------------------

_ENTRY = 'url, mime, status, filename, "offset", length'


def _stored_index(t: Tables) -> str:
    path = scratch_dir(t.spark, "index")
    lines = t.index_lines().withColumn("site", F.lit("all"))
    ci.write_index_table(lines.repartition("crawl").sortWithinPartitions("crawl", "line_no"), path)
    return path


@query("src03_index_lines", f"SELECT crawl, url, mime, status, filename, \"offset\", CAST(length AS BIGINT) AS length FROM ({d.CRAWL_INDEX})")
def src03(t: Tables):
    rows = ci.parse_index_lines(t.index_lines())
    return rows.select("crawl", "url", "mime", "status", "filename", "offset", "length")


@query("src10_index_by_site_and_crawl", f"SELECT crawl, url, \"offset\" FROM ({d.CRAWL_INDEX}) WHERE crawl = 'C-1'")
def src10(t: Tables):
    """Compressed files by site and crawl, one crawl's folder read back."""
    rows = ci.read_index_table(t.spark, _stored_index(t), site="all", crawl="C-1")
    return rows.select("crawl", "url", "offset")


@query("flt01_html_and_ok", f"SELECT line_no FROM ({d.CRAWL_INDEX}) WHERE mime = 'text/html' AND status = '200'")
def flt01(t: Tables):
    return t.crawl_index().filter(ci.usable()).select("line_no")


_USABLE = f"SELECT *, row_number() OVER (PARTITION BY hostpath ORDER BY crawl DESC, line_no) AS rn, first(crawl) OVER (PARTITION BY hostpath ORDER BY crawl DESC, line_no) AS kept FROM ({d.CRAWL_INDEX}) WHERE mime = 'text/html' AND status = '200'"


@query("win1_first_per_hostpath", f"SELECT hostpath, crawl, line_no, url FROM ({_USABLE}) WHERE rn = 1")
def win1(t: Tables):
    return ci.dedup_index(t.crawl_index()).select("hostpath", "crawl", "line_no", "url")


_OUTCOMES = f"""SELECT line_no, CASE WHEN rn = 1 THEN 'kept' WHEN crawl = kept THEN 'dup_cdx' ELSE 'dup_all' END AS outcome FROM ({_USABLE})
  UNION ALL SELECT line_no, CASE WHEN mime IS NULL OR mime <> 'text/html' THEN 'mime' ELSE 'status' END FROM ({d.CRAWL_INDEX})
  WHERE mime IS NULL OR mime <> 'text/html' OR status <> '200'"""


@query("win1_outcomes", _OUTCOMES)
def win1_outcomes(t: Tables):
    return ci.label_outcomes(t.crawl_index()).select("line_no", "outcome")


@query("agg47_outcome_percent", f"SELECT outcome, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM ({_OUTCOMES}) GROUP BY outcome")
def agg47(t: Tables):
    return ci.outcome_counts(t.crawl_index()).withColumn("percent", F.round("percent", 6))


_BLOCKS = f"""SELECT crawl, min(hostpathquery_surt) AS surt, min(line_no) AS "offset", count(*) AS length
  FROM ({d.with_keys(d.CRAWL_INDEX)}) GROUP BY crawl, host_surt"""
_NEXT = f"SELECT *, lead(surt) OVER (PARTITION BY crawl ORDER BY surt) AS next FROM ({_BLOCKS})"


@query(
    "src05_block_range",
    f"SELECT crawl, surt, \"offset\", length FROM ({_NEXT}) WHERE left(surt, {len(PREFIX)}) <= '{PREFIX}' AND coalesce(next >= '{PREFIX}', true)",
)
def src05(t: Tables):
    return ci.select_blocks(t.blocks(), PREFIX).drop("file")


@query(
    "win6_preceding_block",
    f"SELECT crawl, surt, next FROM ({_NEXT}) WHERE surt < '{PREFIX}' AND next >= '{PREFIX}'",
)
def win6(t: Tables):
    """The block reaching into a prefix and the one after it, as max and min per crawl."""
    b = t.blocks()
    return b.groupBy("crawl").agg(
        F.max(F.when(F.col("surt") < PREFIX, F.col("surt"))).alias("surt"),
        F.min(F.when(F.col("surt") >= PREFIX, F.col("surt"))).alias("next"),
    ).filter("surt IS NOT NULL AND next IS NOT NULL")


@query(
    "src06_block_slices",
    f"SELECT hostpathquery_surt AS key, count(*) AS n FROM ({d.with_keys(d.CRAWL_INDEX)}) WHERE hostpathquery_surt LIKE '{PREFIX}%' GROUP BY 1",
)
def src06(t: Tables):
    """Packed index blocks read by byte range, then cut to the prefix."""
    path = scratch_dir(t.spark, "blocks")
    lines = t.index_lines().repartitionByRange("value").sortWithinPartitions("value")
    lines.select("value").write.option("compression", "gzip").text(path)
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    blocks = files.select(F.col("path").alias("file"), F.lit(0).cast("bigint").alias("offset"), "length")
    found = rc.read_blocks(blocks, PREFIX).filter("error IS NULL")
    return found.groupBy(F.split_part("value", F.lit(" "), F.lit(1)).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "win5_even_split",
    f"SELECT 20 AS workers, count(*) AS n, true AS even FROM ({d.CRAWL_INDEX})",
)
def win5(t: Tables):
    """Every row has one of 20 labels and no label holds over twice its share."""
    rows = t.crawl_index().groupBy(ci.worker_label(20, "filename", "offset").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.agg(
        F.count(F.lit(1)).cast("int").alias("workers"), F.sum("n").alias("n"), (F.max("n") * 20 <= F.sum("n") * 2).alias("even")
    )


# Records ---------------------------------------------------------------------

_KIND = "CASE event_type WHEN 'signup' THEN 'request' ELSE 'response' END"
_TIME = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"


@query("src08_members", f"SELECT url, {_KIND} AS rec_type, {_TIME} AS accessed_at, CAST(length(html) AS BIGINT) AS n FROM ({d.FETCHED}) WHERE event_type <> 'click' UNION ALL SELECT NULL, NULL, NULL, -1 FROM ({d.FETCHED}) WHERE event_type = 'click'")
def src08(t: Tables):
    """Single packed members; damaged ones stay as error rows."""
    rows = rc.decode_members(t.members(damage=True), "page_id", "member")
    n = F.coalesce(F.length("html"), F.lit(-1)).cast("bigint")
    return rows.select("url", "rec_type", "accessed_at", n.alias("n"))


@query("src08_bad_records", f"SELECT CAST(page_id AS VARCHAR) AS source, 'bad gzip member: truncated' AS error FROM ({d.FETCHED}) WHERE event_type = 'click'")
def src08_bad(t: Tables):
    rows = rc.decode_members(t.members(damage=True), "page_id", "member")
    return rows.filter("error IS NOT NULL").select("source", "error")


def _archive(t: Tables):
    """Members appended to archive files, and the table of where each lies."""
    root = scratch_dir(t.spark, "archive")
    return root, persist_table(rc.write_members(t.members(), "page_id", "member", root), "archive-index")


_PAGE_SQL = f"SELECT url, CAST(length(html) AS BIGINT) AS n FROM ({d.FETCHED}) WHERE event_type IN ('click', 'view')"


@query("src07_whole_archives", _PAGE_SQL)
def src07(t: Tables):
    root, _ = _archive(t)
    rows = rc.read_archives(t.spark, f"{root}/*.warc.gz")
    return rows.filter(rc.is_page()).select("url", F.length("html").cast("bigint").alias("n"))


@query("src09_byte_ranges", _PAGE_SQL)
def src09(t: Tables):
    """Fetch plan over the index, then only the planned ranges are read."""
    root, index = _archive(t)
    rows = rc.fetch_records(ci.fetch_plan(index), root)
    return rows.filter(rc.is_page()).select("url", F.length("html").cast("bigint").alias("n"))


@query("src09_fetch_plan", f'SELECT line_no, filename, "offset" AS range_start, "offset" + length - 1 AS range_end FROM ({d.CRAWL_INDEX})')
def src09_plan(t: Tables):
    return ci.fetch_plan(t.crawl_index()).select("line_no", "filename", "range_start", "range_end")


@query("flt02_responses", f"SELECT url FROM ({d.FETCHED}) WHERE event_type <> 'signup'")
def flt02(t: Tables):
    return rc.decode_members(t.members(), "page_id", "member").filter("rec_type = 'response'").select("url")


@query("flt03_status_2xx", f"SELECT url FROM ({d.FETCHED}) WHERE event_type <> 'error' AND event_type <> 'signup'")
def flt03(t: Tables):
    rows = rc.decode_members(t.members(), "page_id", "member").filter("rec_type = 'response'")
    return rows.filter(F.col("statusline").startswith("2")).select("url")


@query("flt04_content_type", _PAGE_SQL)
def flt04(t: Tables):
    rows = rc.decode_members(t.members(), "page_id", "member")
    return rows.filter(rc.is_page()).select("url", F.length("html").cast("bigint").alias("n"))


# Keyed first, latest and insert-if-absent ------------------------------------

_VISIT_KEYS = d.with_keys(d.VISITS)
_ARTS = d.ARTICLES


def _visits(t: Tables):
    return t.visits().withColumn("hostpath_surt", uk.url_hostpath_surt("url"))


@query("win2_latest_per_key", f"SELECT hostpath_surt, event_id FROM ({_VISIT_KEYS}) QUALIFY row_number() OVER (PARTITION BY hostpath_surt ORDER BY ts DESC, event_id DESC) = 1")
def win2(t: Tables):
    rows = _visits(t).select("hostpath_surt", "ts", "event_id")
    return cp.first_by(rows, ["hostpath_surt"], ["ts", "event_id"], latest=True).select("hostpath_surt", "event_id")


@query("win2_page_view", f"SELECT event_id AS id, url, ts AS accessed_at FROM ({_VISIT_KEYS}) WHERE hostpath_surt = 'com,example,ththre)/fr/825' ORDER BY ts DESC, event_id DESC LIMIT 1")
def win2_page_view(t: Tables):
    rows = t.visits().select(F.col("event_id").alias("id"), "url", F.col("ts").alias("accessed_at"))
    return cp.page_view(rows, url="HTTP://www.ththre.example.com/fr/825/?page=7")


@query("jon7_latest_with_ties", f"SELECT hostpath_surt, event_id FROM ({_VISIT_KEYS}) QUALIFY rank() OVER (PARTITION BY hostpath_surt ORDER BY date_trunc('day', ts) DESC) = 1")
def jon7(t: Tables):
    """All captures of the last day a page was seen."""
    rows = _visits(t).withColumn("day", F.date_trunc("DAY", "ts"))
    return cp.latest_ties(rows, "hostpath_surt", "day").select("hostpath_surt", "event_id")


@query("win3_first_per_key", f"SELECT hostpath_surt, id FROM ({_ARTS}) QUALIFY row_number() OVER (PARTITION BY hostpath_surt ORDER BY id) = 1")
def win3(t: Tables):
    return cp.first_by(t.articles().select("hostpath_surt", "id"), ["hostpath_surt"], ["id"])


def _titled(t: Tables):
    host = uk.url_host(uk.unsurt("hostpath_surt"))
    return t.articles().select("id", "hostpath_surt", host.alias("host"), F.nullif("title", F.lit("")).alias("title"))


_TITLED = f"SELECT id, hostpath_surt, {d.unsurt_host('hostpath_surt')} AS host, nullif(title, '') AS title FROM ({_ARTS})"


@query("win4_first_per_title", f"SELECT id FROM ({_TITLED}) WHERE title IS NULL UNION ALL SELECT min(id) FROM ({_TITLED}) WHERE title IS NOT NULL GROUP BY host, title")
def win4(t: Tables):
    rows = _titled(t)
    named = cp.first_by(rows.filter("title IS NOT NULL"), ["host", "title"], ["id"])
    return named.select("id").unionByName(rows.filter("title IS NULL").select("id"))


@query(
    "win4_first_wins_on_both_keys",
    f"""WITH RECURSIVE r AS (
      SELECT id, hostpath_surt AS a, CASE WHEN title IS NOT NULL THEN host || chr(1) || title END AS b, false AS kept FROM ({_TITLED})
      UNION ALL
      SELECT id, a, b, win FROM (
        SELECT *, bool_or(win) OVER (PARTITION BY a) AS by_a, b IS NOT NULL AND bool_or(win) OVER (PARTITION BY b) AS by_b FROM (
          SELECT id, a, b, id = min(id) OVER (PARTITION BY a) AND (b IS NULL OR id = min(id) OVER (PARTITION BY b)) AS win FROM r WHERE NOT kept))
      WHERE win OR NOT (by_a OR by_b))
    SELECT id, a AS hostpath_surt FROM r WHERE kept""",
)
def win4_both(t: Tables):
    """Insert order under two unique keys."""
    return cp.first_wins(_titled(t), "id").select("id", "hostpath_surt")


_OLD, _NEW = "timestamp_published < '1999-01-01'", "timestamp_published >= '1999-01-01'"


def _rounds(name: str, source: str) -> str:
    """Recursive CTE ``name`` (id, a, b, kept): insertion in id order, round by round."""
    return f"""{name} AS (
      SELECT id, a, b, false AS kept FROM ({source})
      UNION ALL
      SELECT id, a, b, win FROM (
        SELECT *, bool_or(win) OVER (PARTITION BY a) AS by_a, b IS NOT NULL AND bool_or(win) OVER (PARTITION BY b) AS by_b FROM (
          SELECT id, a, b, id = min(id) OVER (PARTITION BY a) AND (b IS NULL OR id = min(id) OVER (PARTITION BY b)) AS win FROM {name} WHERE NOT kept))
      WHERE win OR NOT (by_a OR by_b))"""


_AB = f"""SELECT id, timestamp_published, x.hostpath_surt AS a, CASE WHEN x.title IS NOT NULL THEN x.host || chr(1) || x.title END AS b
  FROM ({_ARTS}) a JOIN ({_TITLED}) x USING (id)"""


@query(
    "snk2_insert_if_absent",
    f"""WITH RECURSIVE ab AS MATERIALIZED ({_AB}), {_rounds('o', f'SELECT * FROM ab WHERE {_OLD}')},
      old AS MATERIALIZED (SELECT * FROM o WHERE kept),
      fresh AS MATERIALIZED (SELECT * FROM ab n WHERE {_NEW} AND NOT EXISTS (SELECT 1 FROM old WHERE old.a = n.a) AND NOT EXISTS (SELECT 1 FROM old WHERE old.b = n.b)),
      {_rounds('r', 'SELECT * FROM fresh')}
    SELECT id FROM r WHERE kept""",
)
def snk2(t: Tables):
    """Newer articles inserted one by one into the view of the older ones."""
    # Stored, since both the view and the insertion read them several times.
    rows = persist_table(_titled(t).join(t.articles().select("id", "timestamp_published"), "id"), "titled")
    old = persist_table(cp.first_wins(rows.filter(_OLD), "id"), "article-view")
    return cp.insert_articles(rows.filter(_NEW), old, "id").select("id")


@query(
    "jon9_conflicts",
    f"SELECT n.id FROM ({_ARTS}) n WHERE {_NEW} AND n.hostpath_surt IN (SELECT hostpath_surt FROM ({_ARTS}) WHERE {_OLD})",
)
def jon9(t: Tables):
    rows = t.articles()
    return rows.filter(_NEW).join(rows.filter(_OLD).select("hostpath_surt"), "hostpath_surt", "left_semi").select("id")


# Lists -----------------------------------------------------------------------

_GOLD = d.with_keys(d.GOLDEN)


def _uncovered(rows: str) -> str:
    return f"SELECT DISTINCT host_surt FROM ({rows}) WHERE host_surt NOT IN (SELECT DISTINCT host_surt FROM ({_GOLD}))"


def _gold(t: Tables):
    return t.golden().select("url")


@query("jon6_untested_list_hosts", _uncovered(rows=d.with_keys(d.LISTED)))
def jon6(t: Tables):
    return lists.uncovered(t.listed(), _gold(t))


@query("set4_untested_article_hosts", _uncovered(rows=_ARTS))
def set4(t: Tables):
    return lists.uncovered(t.articles(), _gold(t))


@query("top8_untested_sorted", _uncovered(rows=d.with_keys(d.LISTED)) + " ORDER BY host_surt")
def top8(t: Tables):
    return jon6(t).orderBy(F.col("host_surt").asc_nulls_last())


_LABELLED = f"SELECT a.* FROM ({_ARTS}) a JOIN labels l ON l.doc_id = a.id"


@query(
    "qlt3_list_coverage",
    " UNION ALL ".join(
        f"SELECT '{name}' AS list, count(*) AS untested FROM ({_uncovered(rows=rows)})"
        for name, rows in {
            "curated": f"SELECT * FROM ({d.with_keys(d.LISTED)}) WHERE coalesce(priority, '') <> 'ban'",
            "bias_a": d.with_keys(d.LISTED), "bias_b": d.with_keys(d.VISITS), "labelled": _LABELLED,
        }.items()
    ),
)
def qlt3(t: Tables):
    """Hosts of each list without a tested page."""
    labelled = t.articles().join(t.read("labels").select(F.col("doc_id").alias("id")), "id")
    parts = {"curated": t.listed().filter(lists.not_banned()), "bias_a": t.listed(), "bias_b": t.visits(), "labelled": labelled}
    return qa.audit(*[
        lists.uncovered(rows, _gold(t)).agg(F.count(F.lit(1)).alias("untested")).select(F.lit(name).alias("list"), "untested")
        for name, rows in parts.items()
    ])


_ALL_UNTESTED = f"({_uncovered(rows=d.with_keys(d.LISTED))}) UNION ({_uncovered(rows=_ARTS)})"


@query("set1_union_of_lists", _ALL_UNTESTED)
def set1(t: Tables):
    return jon6(t).union(set4(t)).distinct()


_RANKED = f"""SELECT coalesce(rank, 0) AS rank, array_to_string(list_reverse(string_split(left(u.host_surt, length(u.host_surt) - 1), ',')), '.') AS host
  FROM (SELECT host_surt, host, count(*)::INTEGER AS rank FROM ({d.PAGES}) GROUP BY ALL) r RIGHT JOIN ({_ALL_UNTESTED}) u ON u.host_surt = r.host_surt"""


@query("jon2_ranked_untested", _RANKED)
def jon2(t: Tables):
    return lists.untested_by_rank(t.rank_list(), jon6(t), set4(t)).withColumn("rank", F.coalesce("rank", F.lit(0)))


@query("top5_untested_by_rank", _RANKED + " ORDER BY r.rank ASC NULLS LAST, host")
def top5(t: Tables):
    return jon2(t)


@query(
    "top1_host_panel",
    f"SELECT * FROM ({capture_sql('agg08_exceptions')}) WHERE host LIKE '%.example.com' ORDER BY url DESC, host, type NULLS LAST, location NULLS LAST, hostpathquery, hostpath LIMIT 20",
)
def top1(t: Tables):
    panel = ru.rollup(cp.capture_facts(t.captures()), capture_spec("agg08_exceptions"))
    return lists.top_hosts(panel, ".example.com")


@query(
    "top4_hosts_to_check",
    f"""SELECT array_to_string(list_reverse(string_split(left(host, length(host) - 1), ',')), '.') AS host, {d.language('language')} AS language_iso639,
      round(pow(hostpath, 1.5) / (1 + timestamp_published), 6) AS score, timestamp_published, hostpath
      FROM ({capture_sql('agg12_host_language_stats')}) WHERE host NOT IN (SELECT host_surt FROM ({_GOLD})) ORDER BY score DESC, host""",
)
def top4(t: Tables):
    stats = ru.rollup(cp.capture_facts(t.captures()), capture_spec("agg12_host_language_stats"))
    return lists.hosts_to_check(stats, lists.host_keys(_gold(t))).withColumn("score", F.round("score", 6))


# Audits ----------------------------------------------------------------------

#: Sources are the customers of all segments but one, whose sources were given up.
_SOURCES = "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY'"
_ORPHANS = f"SELECT event_id, user_id FROM events WHERE user_id NOT IN ({_SOURCES})"
#: A code table: nations by name, with a two-letter and a three-letter code.
_CODES = "SELECT n_name AS ref_name, right(n_name, 2) AS part1, 'n' || right(n_name, 1) AS part3 FROM nation"


def _orphans(t: Tables):
    sources = t.read("customer").filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("user_id"))
    return qa.orphans(t.read("events").select("event_id", "user_id"), sources, "user_id")


@query("jon8_orphans", _ORPHANS)
def jon8(t: Tables):
    """Captures whose source is not a known one."""
    return _orphans(t)


@query(
    "qlt1_constraints",
    f"""WITH a AS (SELECT * FROM ({_TITLED})), l AS (SELECT * FROM ({d.LISTED})), c AS ({_CODES})
      SELECT 'host lower case' AS rule, count(*) FILTER (hostname <> lower(hostname))::BIGINT AS violations FROM l
      UNION ALL SELECT 'host present', count(*) FILTER (hostname IS NULL)::BIGINT FROM l
      UNION ALL SELECT 'priority present', count(*) FILTER (priority IS NULL)::BIGINT FROM l
      UNION ALL SELECT 'language normalised', count(*) FILTER (lang <> {d.language('lang')})::BIGINT FROM documents
      UNION ALL SELECT 'code part1 unique', (count(part1) - count(DISTINCT part1))::BIGINT FROM c
      UNION ALL SELECT 'code part3 unique', (count(part3) - count(DISTINCT part3))::BIGINT FROM c
      UNION ALL SELECT 'code name unique', (count(ref_name) - count(DISTINCT ref_name))::BIGINT FROM c
      UNION ALL SELECT 'code present', count(*) FILTER (part3 IS NULL OR ref_name IS NULL)::BIGINT FROM c
      UNION ALL SELECT 'key unique', (count(*) - count(DISTINCT hostpath_surt))::BIGINT FROM a
      UNION ALL SELECT 'article present', count(*) FILTER (hostpath_surt IS NULL OR host IS NULL)::BIGINT FROM a
      UNION ALL SELECT 'title unique per host', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM a WHERE title IS NOT NULL GROUP BY host, title)
      UNION ALL SELECT 'title present', count(*) FILTER (title IS NULL)::BIGINT FROM a
      UNION ALL SELECT 'capture present', count(*) FILTER (user_id IS NULL OR ts IS NULL)::BIGINT FROM events
      UNION ALL SELECT 'source known', count(*)::BIGINT FROM ({_ORPHANS})""",
)
def qlt1(t: Tables):
    arts = _titled(t)
    codes = t.read("nation").select(
        F.col("n_name").alias("ref_name"), F.expr("right(n_name, 2)").alias("part1"), F.expr("'n' || right(n_name, 1)").alias("part3")
    )
    return qa.audit(
        qa.violations(t.listed(), "host lower case", F.col("hostname") != F.lower("hostname")),
        qa.missing(t.listed(), "host present", "hostname"),
        qa.missing(t.listed(), "priority present", "priority"),
        qa.violations(t.read("documents"), "language normalised", F.col("lang") != sc.language_iso639("lang")),
        qa.duplicate_keys(codes, "code part1 unique", "part1"),
        qa.duplicate_keys(codes, "code part3 unique", "part3"),
        qa.duplicate_keys(codes, "code name unique", "ref_name"),
        qa.missing(codes, "code present", "part3", "ref_name"),
        qa.duplicate_keys(arts, "key unique", "hostpath_surt"),
        qa.missing(arts, "article present", "hostpath_surt", "host"),
        qa.duplicate_keys(arts, "title unique per host", "host", "title"),
        qa.missing(arts, "title present", "title"),
        qa.missing(t.read("events"), "capture present", "user_id", "ts"),
        qa.violations(_orphans(t), "source known", F.lit(True)),
    )


@query(
    "str5_append_only_audit",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'changed' END AS change FROM events WHERE event_type IN ('error', 'signup')",
)
def str5(t: Tables):
    """Snapshot against a later one where some rows went and some changed."""
    before = t.read("events").select("event_id", "user_id", "event_type")
    after = before.filter("event_type <> 'error'").withColumn(
        "user_id", F.when(F.col("event_type") == "signup", F.col("user_id") + 1).otherwise(F.col("user_id"))
    )
    return qa.changed_keys(before, after, "event_id", ["user_id"])


# Sinks and ledger ------------------------------------------------------------

def _visit_captures(t: Tables):
    return t.visits().select("event_id", F.col("event_type").alias("id_source"), "ts", "url")


@query("snk1_append_with_ledger", f"SELECT event_type AS source, count(*) AS urls_inserted FROM ({d.VISITS}) GROUP BY 1")
def snk1(t: Tables):
    """One batch written, then written again as a replay: counted once."""
    path, book = scratch_dir(t.spark, "captures"), scratch_dir(t.spark, "ledger")
    for _ in range(2):
        ledger.append_batch(_visit_captures(t), 0, path, book)
    return ledger.read_ledger(t.spark, book).select("source", "urls_inserted")


_FOUND = f"""SELECT id, hostpath_surt, trim(replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g'), '&amp;', '&')) AS title
  FROM ({d.CAPTURES}) WHERE event_type <> 'error' AND language IS NOT NULL"""
_IN_ORDER = f"""SELECT (id % 2) * 1000000000 + id AS id, hostpath_surt AS a, {d.unsurt_host('hostpath_surt')} || chr(1) || title AS b
  FROM ({_FOUND}) WHERE title <> ''"""


@query(
    "snk1_articles_of_batches",
    f"""WITH RECURSIVE {_rounds('r', _IN_ORDER)}
    SELECT id % 1000000000 AS id, id // 1000000000 AS batch FROM r WHERE kept""",
)
def snk1_articles(t: Tables):
    """Two batches of captures into captures, ledger and article view, the second one replayed."""
    path, book, view = (scratch_dir(t.spark, x) for x in ("captures", "ledger", "articles"))
    rows = t.stored_captures()
    for batch in (0, 1, 1):
        ledger.append_batch(rows.filter(F.col("id") % 2 == batch), batch, path, book, articles_path=view)
    return t.spark.read.parquet(view).select("id", F.col("batch").cast("bigint").alias("batch"))


@query("snk3_archive_table", f"SELECT host_surt AS surt, count(*) AS n FROM ({d.PAGES}) GROUP BY 1")
def snk3(t: Tables):
    path = scratch_dir(t.spark, "records")
    pages = t.read("pages").select("url", "html", uk.url_host_surt("url").alias("surt"), F.lit("C-0").alias("crawl"))
    ledger.write_archive(pages, path)
    ledger.write_archive(pages, path, force=True)
    return t.spark.read.parquet(path).groupBy("surt").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snk4_pending_sources",
    "SELECT source, CASE WHEN source = 'view' THEN 0 ELSE n END AS urls_inserted FROM (SELECT event_type AS source, count(*) AS n FROM (" + d.VISITS + ") GROUP BY 1) WHERE source <> 'click'",
)
def snk4(t: Tables):
    """``click`` is finished, ``view`` not begun, the others are under way."""
    path, book = scratch_dir(t.spark, "captures"), scratch_dir(t.spark, "ledger")
    rows = _visit_captures(t)
    ledger.append_batch(rows.filter("id_source <> 'view'"), 0, path, book)
    found = rows.select(F.col("id_source").alias("source")).distinct()
    ledger.finish_sources(t.spark, found.filter("source = 'click'"), book, 1)
    return ledger.pending(found, ledger.read_ledger(t.spark, book))


# Streams ---------------------------------------------------------------------

def _event_files(t: Tables, parts: int = 4) -> str:
    """The events as several files, dealt out without regard to time."""
    path = scratch_dir(t.spark, "arrivals")
    t.events().select("event_id", "ts", "user_id", "event_type").repartition(parts, "event_id").write.parquet(path)
    return path


_EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string"


def _visit_stream(t: Tables, path: str):
    stream = jobs.file_stream(t.spark, path, _EVENT_SCHEMA, files_per_batch=2)
    pages = t.read("pages").select(F.col("page_id").alias("user_id"), "url")
    return stream.join(pages, "user_id")


@query("str1_ingest_stream", f"SELECT event_type AS source, count(*) AS urls_inserted FROM ({d.VISITS}) GROUP BY 1")
def str1(t: Tables):
    path, book = scratch_dir(t.spark, "captures"), scratch_dir(t.spark, "ledger")
    stream = _visit_stream(t, _event_files(t)).select("event_id", F.col("event_type").alias("id_source"), "ts", "url")
    jobs.stream_ingest(stream, path, book, scratch_dir(t.spark, "checkpoint")).awaitTermination()
    return ledger.read_ledger(t.spark, book).select("source", "urls_inserted")


def _streamed_rollup(t: Tables, spec: ru.RollupSpec, with_rows: bool = False):
    target = scratch_dir(t.spark, "stream-rollup")
    stream = _visit_stream(t, _event_files(t))
    jobs.stream_rollup(stream, spec, target, scratch_dir(t.spark, "checkpoint")).awaitTermination()
    return jobs.read_rollup(t.spark, spec, target, with_rows)


@query("str2_incremental_rollup", f"SELECT host, {d.BUNDLE}, count(*) AS n_rows FROM ({_VISIT_KEYS}) GROUP BY host")
def str2(t: Tables):
    return _streamed_rollup(t, ru.RollupSpec({"host": uk.url_host("url")}, ru.url_measures("url")), with_rows=True)


@query("str6_late_rows", f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(DISTINCT url) AS url FROM ({d.VISITS}) GROUP BY 1")
def str6(t: Tables):
    """Rows arrive in no order of time; merged sketches take them all."""
    return _streamed_rollup(t, ru.RollupSpec({"day": sc.day_of("ts")}, {"url": F.col("url")}))


@query("str3_tumbling_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def str3(t: Tables):
    return jobs.tumbling_counts(t.events(), "ts", "1 hour", ["event_type"], "2 hours")


@query(
    "str3_tumbling_windows_stream",
    "SELECT * FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)",
)
def str3_stream(t: Tables):
    """Windows the watermark has closed, as an append stream writes them."""
    path, out = _event_files(t, 1), scratch_dir(t.spark, "windows")
    stream = jobs.file_stream(t.spark, path, _EVENT_SCHEMA)
    counts = jobs.tumbling_counts(stream, "ts", "1 hour", ["event_type"], "2 hours")
    counts.writeStream.outputMode("append").format("parquet").option("path", out).option(
        "checkpointLocation", scratch_dir(t.spark, "checkpoint")
    ).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(counts.schema).parquet(out)


@query(
    "str4_stream_dedup",
    f"SELECT DISTINCT hostpath_surt FROM ({_VISIT_KEYS}) EXCEPT SELECT hostpath_surt FROM ({d.CAPTURES}) WHERE event_type = 'error'",
)
def str4(t: Tables):
    """First arrivals of pages not already stored."""
    stored = t.fetched_pages().filter("event_type = 'error'").select(uk.url_hostpath_surt("url").alias("hostpath_surt"))
    stream = _visit_stream(t, _event_files(t)).withColumn("hostpath_surt", uk.url_hostpath_surt("url"))
    out = scratch_dir(t.spark, "first-arrivals")
    jobs.stream_dedup(
        stream, "hostpath_surt", "ts", "60 days", stored, out, scratch_dir(t.spark, "checkpoint")
    ).awaitTermination()
    return t.spark.read.parquet(out).select("hostpath_surt")


@query("udx4_python_readers", f"SELECT rec_type, count(*) AS n FROM (SELECT {_KIND} AS rec_type FROM ({d.FETCHED})) GROUP BY 1")
def udx4(t: Tables):
    """Python is used only to unpack records; all that follows is native."""
    return rc.decode_members(t.members(), "page_id", "member").groupBy("rec_type").agg(F.count(F.lit(1)).alias("n"))


# Per visit of a page named in the index: what its row says and what its page holds.
_CRAWLED = f"""SELECT i.crawl, i.line_no, i.hostpath, v.ts, v.event_type, p.url, o.o_orderdate AS published,
      nullif(regexp_extract(p.html, '<html lang="([^"]*)"', 1), '') AS lang,
      trim(replace(regexp_replace(regexp_extract(p.html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g'), '&amp;', '&')) AS title
    FROM ({d.CRAWL_INDEX}) i JOIN events v ON v.event_id = i.line_no JOIN pages p ON p.page_id = v.user_id JOIN orders o ON o.o_orderkey = p.page_id"""
_CHOSEN = f"""SELECT * FROM ({_CRAWLED}) WHERE event_type IN ('view', 'click') QUALIFY row_number() OVER (PARTITION BY hostpath ORDER BY crawl DESC, line_no) = 1"""


@query(
    "ingest_crawl_to_articles",
    f"""WITH RECURSIVE k AS MATERIALIZED ({d.with_keys(_CHOSEN)}),
      f AS MATERIALIZED (SELECT line_no AS id, hostpath_surt AS a, {d.unsurt_host('hostpath_surt')} || chr(1) || title AS b FROM k WHERE lang IS NOT NULL AND title <> ''),
      {_rounds('r', 'SELECT * FROM f')}
    SELECT r.id, k.hostpath_surt, {d.language('k.lang')} AS language, k.published::TIMESTAMP AS timestamp_published, k.title FROM r JOIN k ON k.line_no = r.id WHERE kept""",
)
def ingest(t: Tables):
    """Crawl index to the article view: index dedup, fetch plan, records, page filter, captures, articles, first wins."""
    root = scratch_dir(t.spark, "archive")
    places = persist_table(rc.write_members(t.visit_members(), "page_id", "member", root), "archive-index")
    index = t.crawl_index().drop("filename", "offset", "length").join(
        places.withColumn("line_no", F.col("key").cast("bigint")).drop("key"), "line_no"
    )
    entry = F.to_json(F.struct("url", "mime", "status", "filename", *[F.col(c).cast("string").alias(c) for c in ("offset", "length")]))
    lines = index.select("crawl", "line_no", F.concat_ws(" ", "key", "time", entry).alias("value"))

    plan = persist_table(ci.dedup_index(ci.parse_index_lines(lines)), "fetch")
    fetched = rc.fetch_records(ci.fetch_plan(plan), root).filter(rc.is_page())
    named = cp.drop_invalid(fetched).join(
        plan.select(F.col("filename").alias("source"), F.col("offset").alias("position"), F.col("line_no").alias("id"), "crawl"),
        ["source", "position"],
    )
    captures = persist_table(ex.to_captures(named, "id", "crawl"), "captures")
    articles = persist_table(cp.to_articles(captures), "candidates").withColumn("host", uk.url_host(uk.unsurt("hostpath_surt")))
    kept = cp.first_wins(articles, "id")
    return kept.select("id", "hostpath_surt", "language", "timestamp_published", "title")
