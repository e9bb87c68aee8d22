"""The given tables seen as the system's own: captures, articles, visits, links.

Only mappings live here. Every view is a lazy DataFrame over whole tables, so
what a query does not use is neither read nor computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..functions import urlkeys as uk
from ..operators import extract as ex
from ..session import persist_table
from ..sources.records import BATCH_RECORDS


#: Texts that one task takes apart.
TEXTS_A_TASK = 2000


def _tokenised(articles: DataFrame) -> DataFrame:
    out = tx.with_tokens(articles, "title", "language", "tsv_title")
    return tx.with_tokens(out, "content", "language", "tsv_content")


def _joined(tokenised: DataFrame) -> DataFrame:
    return tokenised.withColumn("tokens", tx.concat_tokens("tsv_title", "tsv_content"))


def alltext_vectors(articles: DataFrame) -> DataFrame:
    """Articles, wherever they lie, with both vectors joined as ``tokens``; see :meth:`Tables.alltext`."""
    return _joined(_tokenised(articles))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def fetched_pages(self) -> DataFrame:
        """Pages with the event that fetched them and a publication time."""
        events = self.events().select("event_id", "ts", "user_id", "event_type")
        orders = self.read("orders").select("o_orderkey", "o_orderdate")
        return (
            self.read("pages")
            .join(events, F.col("page_id") == F.col("event_id"))
            .join(orders, F.col("page_id") == F.col("o_orderkey"))
            .withColumn("published", F.col("o_orderdate").cast("timestamp"))
        )

    def captures(self) -> DataFrame:
        """id, id_source, accessed_at, inserted_at, url, doc (typed metadata).

        Pages fetched by an ``error`` event failed to parse and carry only an
        exception.
        """
        h = F.col("html")
        ok = F.col("event_type") != "error"
        iso = "yyyy-MM-dd HH:mm:ss"

        def best(value, present=None):
            here = ok if present is None else ok & present
            return F.when(here, F.struct(F.struct(value.alias("value")).alias("best")))

        def span(lo, hi):
            return F.struct(lo.alias("lo"), hi.alias("hi"))

        kind = F.when(F.col("event_type") == "view", "article").otherwise(F.col("event_type"))
        published = span(
            F.date_format("published", iso), F.date_format(F.col("published") + F.expr("INTERVAL 1 DAY"), iso)
        )
        modified = span(F.date_format("ts", iso), F.date_format("ts", iso))
        links = ex.page_links(h)
        inner = F.filter(links, lambda x: F.length(x["href"]) % 2 == 1)
        failure = F.struct(
            F.lit("cannot parse").alias("str(e)"),
            F.lit("ParseError").alias("type"),
            F.concat(F.lit("step-"), (F.col("user_id") % 2).cast("string")).alias("location"),
            F.lit("").alias("traceback"),
        )
        doc = F.struct(
            best(ex.page_language(h)).alias("language"),
            best(ex.page_title(h)).alias("title"),
            best(ex.page_description(h)).alias("description"),
            best(kind).alias("type"),
            best(
                F.struct(ex.page_article(h).alias("html"), ex.page_text(h).alias("text"))
            ).alias("content"),
            best(F.lit(None).cast("string")).alias("author"),
            best(F.col("url")).alias("url.canonical"),
            best(published).alias("timestamp.published"),
            best(modified, F.col("event_type") == "purchase").alias("timestamp.modified"),
            best(links).alias("links.all"),
            best(inner).alias("links.content"),
            F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("version"),
            F.when(~ok, failure).alias("exception"),
        )
        return self.fetched_pages().select(
            F.col("page_id").alias("id"),
            F.col("user_id").alias("id_source"),
            F.col("ts").alias("accessed_at"),
            (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("inserted_at"),
            "url",
            doc.alias("doc"),
        )

    def stored_captures(self) -> DataFrame:
        """Captures as a table, for jobs that read several parts of a document."""
        return persist_table(self.captures(), "captures")

    def articles(self) -> DataFrame:
        """Article view over documents, before deduplication.

        What is read off a text is taken before the joins, so a text that a query does
        not use is not moved by them.
        """
        orders = self.read("orders").select("o_orderkey", "o_orderdate")
        pages = self.read("pages").select("page_id", "url")
        documents = self.read("documents").select(
            "doc_id", "lang", "source", "n_chars", "text",
            F.regexp_extract("text", r"^[^\n.]*", 0).alias("title"),
            F.nullif(F.regexp_extract("text", r"\n([^\n.]*)", 1), F.lit("")).alias("description"),
        )
        made = F.concat(
            F.lit("https://www."), F.col("source"), F.lit(".example.org/"), F.col("lang"), F.lit("/"),
            F.col("n_chars").cast("string"),
        )
        return (
            documents
            .join(orders, F.col("doc_id") == F.col("o_orderkey"))
            .join(pages, F.col("doc_id") == F.col("page_id"), "left")
            .select(
                F.col("doc_id").alias("id"),
                F.coalesce("url", made).alias("url"),
                F.col("lang").alias("language"),
                F.col("o_orderdate").cast("timestamp").alias("timestamp_published"),
                "title",
                "description",
                F.col("text").alias("content"),
                F.col("source").alias("id_source"),
            )
            .withColumn("hostpath_surt", uk.url_hostpath_surt("url"))
        )

    def tokenised(self) -> DataFrame:
        """Articles with tsv_title and tsv_content.

        Texts are dealt out evenly first: tokens cost far more than moving a text,
        and a file of one row group would leave them all to one task. A task gets a
        bounded number of them however many there are, since their n-grams take some
        twenty times their room, and those of one language and month lie together.
        """
        tasks = max(self.spark.sparkContext.defaultParallelism, self.read("documents").count() // TEXTS_A_TASK)
        arts = self.articles().repartitionByRange(tasks, "language", F.date_trunc("MONTH", "timestamp_published"), "id")
        return _tokenised(arts)

    def alltext(self) -> DataFrame:
        """Articles with both vectors joined as ``tokens``."""
        return _joined(self.tokenised())

    def visits(self) -> DataFrame:
        """Many captures per page: every event is a visit to its user's page."""
        return self.events().join(
            self.read("pages").select("page_id", "url"), F.col("user_id") == F.col("page_id")
        ).select("event_id", "ts", "user_id", "event_type", "value", "url")

    def crawl_index(self) -> DataFrame:
        """Visits as crawl-index rows; ``line_no`` is the order in a crawl's file."""
        return self.visits().select(
            F.concat(F.lit("C-"), F.floor((F.dayofmonth("ts") - 1) / 10).cast("string")).alias("crawl"),
            F.col("event_id").alias("line_no"),
            uk.url_hostpathquery_surt("url").alias("key"),
            F.date_format("ts", "yyyyMMddHHmmss").alias("time"),
            "url",
            F.when(F.col("event_type") == "purchase", "application/pdf")
            .when(F.col("event_type") != "signup", "text/html").alias("mime"),
            F.when(F.col("event_type") == "error", "404").otherwise("200").alias("status"),
            F.concat(F.lit("archive-"), (F.col("user_id") % 7).cast("string"), F.lit(".warc.gz")).alias("filename"),
            (F.col("event_id") * 1000).alias("offset"),
            F.length("url").cast("bigint").alias("length"),
        )

    def index_lines(self) -> DataFrame:
        entry = F.to_json(
            F.struct(
                "url", "mime", "status", "filename",
                F.col("offset").cast("string").alias("offset"), F.col("length").cast("string").alias("length"),
            )
        )
        return self.crawl_index().select(
            "crawl", "line_no", F.concat_ws(" ", "key", "time", entry).alias("value")
        )

    def blocks(self) -> DataFrame:
        """A sparse block index: one block per crawl and host, at its first key."""
        rows = self.crawl_index()
        return rows.groupBy("crawl", uk.url_host_surt("url").alias("_h")).agg(
            F.min("key").alias("surt"),
            F.lit("cdx-00000.gz").alias("file"),
            F.min("line_no").alias("offset"),
            F.count(F.lit(1)).alias("length"),
        ).drop("_h")

    def members(self, damage: bool = False) -> DataFrame:
        """Pages packed as archive records: (page_id, member).

        The event decides what kind of record it is; ``damage`` cuts the
        members of ``click`` events short.
        """
        return self._packed(self.fetched_pages().select("page_id", "url", "html", "event_type", "ts"), damage)

    def visit_members(self) -> DataFrame:
        """Every visit packed as an archive record: (page_id, member), ``page_id`` the visit's id.

        The page served names the day of its order as publication time.
        """
        pages = self.read("pages").select(F.col("page_id").alias("_page"), "html")
        orders = self.read("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("_day"))
        meta = F.concat(F.lit('<head><meta property="article:published_time" content="'), "_day", F.lit('">'))
        rows = (
            self.visits().join(pages, F.col("user_id") == F.col("_page")).join(orders, F.col("_page") == F.col("o_orderkey"))
        )
        return self._packed(
            rows.select(F.col("event_id").alias("page_id"), "url", F.replace("html", F.lit("<head>"), meta).alias("html"), "event_type", "ts")
        )

    def _packed(self, rows: DataFrame, damage: bool = False) -> DataFrame:
        def packed(page_id, url, html, event_type, time):
            import gzip

            kind = "request" if event_type == "signup" else "response"
            status = "404 Not Found" if event_type == "error" else "200 OK"
            head = f"HTTP/1.1 {status}\r\n"
            if event_type != "view":
                mime = "image/png" if event_type == "purchase" else "text/html; charset=UTF-8"
                head += f"Content-Type: {mime}\r\n"
            body = (head + "\r\n").encode() + html.encode()
            meta = (
                f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\n"
                f"WARC-Date: {time}\r\nContent-Length: {len(body)}\r\n\r\n"
            )
            data = gzip.compress(meta.encode() + body + b"\r\n\r\n", 1, mtime=0)
            return {"page_id": page_id, "member": data[: len(data) // 2] if damage and event_type == "click" else data}

        def pack(batches):
            import pyarrow as pa

            out = pa.schema([("page_id", pa.int64()), ("member", pa.binary())])
            # A batch is thousands of pages; few of them at a time are Python objects.
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH_RECORDS):
                    part = batch.slice(at, BATCH_RECORDS).to_pylist()
                    yield pa.RecordBatch.from_pylist([packed(**r) for r in part], schema=out)

        rows = rows.withColumn("time", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).drop("ts")
        return rows.mapInArrow(pack, "page_id long, member binary")

    def rank_list(self) -> DataFrame:
        """Hosts with a rank: how many pages they have."""
        return self.read("pages").groupBy(uk.url_host("url").alias("host")).agg(
            F.count(F.lit(1)).cast("int").alias("rank")
        )

    def golden(self) -> DataFrame:
        """Pages the parser is tested on: those the error events did not hit."""
        return self.fetched_pages().filter("event_type IN ('view', 'click')").select(
            "url", ex.page_language("html").alias("language")
        )

    def listed(self) -> DataFrame:
        """A curated list: page addresses with a country and a priority."""
        return self.fetched_pages().select(
            "url",
            uk.url_host("url").alias("hostname"),
            F.col("event_type").alias("type"),
            F.when(F.col("user_id") % 5 == 0, "ban").when(F.col("user_id") % 5 == 1, "high").alias("priority"),
            (F.col("user_id") % 4).alias("bias"),
        )

    def page_links(self) -> DataFrame:
        """Links between pages (url, href): an order's page links its parts' pages.

        Keys go around the pages, so that every line is a link.
        """
        pages = self.read("pages").select("page_id", "url")
        n = pages.agg(F.count("*")).scalar()
        lines = self.read("lineitem").select(*[F.pmod(c, n).alias(c) for c in ("l_orderkey", "l_partkey")])
        src = pages.select(F.col("page_id").alias("l_orderkey"), "url")
        dest = pages.select(F.col("page_id").alias("l_partkey"), F.col("url").alias("href"))
        return lines.join(src, "l_orderkey").join(dest, "l_partkey").select("url", "href")
