"""Crawl indexes: rows naming each capture's place in an archive file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.urlkeys import index_hostpath
from ..session import persist_table

ENTRY_SCHEMA = "url string, mime string, status string, digest string, filename string, offset string, length string"


def parse_index_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """``<key> <time> {json}`` lines to columns; the first two fields are cut off."""
    keep = [c for c in lines.columns if c != line_col]
    parts = F.split(F.col(line_col), " ", 3)
    entry = F.from_json(F.get(parts, F.lit(2)), ENTRY_SCHEMA, {"mode": "FAILFAST"})
    return (
        lines.select(*keep, F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("time"), entry.alias("_e"))
        .select(
            *keep, "key", "time", "_e.url", "_e.mime", "_e.status", "_e.filename",
            F.col("_e.offset").cast("bigint").alias("offset"),
            F.col("_e.length").cast("bigint").alias("length"),
        )
    )


def _numbered(lines: DataFrame, partitions: int | None) -> DataFrame:
    """Parsed lines with ``line_no``, rising within each file, as a stored table.

    One task reads a gzip file from its start, so the ids rise with the line.
    Which ids a file gets depends on how files were dealt to tasks; stored,
    they are the same for every job that follows, and the rows can be split.
    """
    lines = lines.withColumn("line_no", F.monotonically_increasing_id())
    if partitions:
        lines = lines.repartition(partitions)
    return persist_table(parse_index_lines(lines), "crawl-index")


def read_crawl_index(
    spark: SparkSession, root: str, site: str | None = None, crawl: str | None = None, partitions: int | None = None
) -> DataFrame:
    """Index files under ``root/<site>/<site>-<crawl>.cdx.gz``.

    All crawls, or sites, when not named. The file name gives ``crawl``. Gzip
    files cannot be split, so ``partitions`` spreads the rows after the scan.
    """
    path = f"{root}/{site or '*'}/{site or '*'}-{crawl or '*'}.cdx.gz"
    lines = spark.read.text(path).select(
        "value",
        F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]*)/[^/]*\z", 1).alias("site"),
        F.col("_metadata.file_name").alias("_file"),
    )
    lines = lines.select(
        "value",
        "site",
        F.regexp_replace(F.substring("_file", F.length("site") + 2, F.length("_file")), r"\.cdx\.gz\z", "").alias("crawl"),
    )
    return _numbered(lines, partitions)


def read_index_table(
    spark: SparkSession, path: str, site: str | None = None, crawl: str | None = None, partitions: int | None = None
) -> DataFrame:
    """Index lines stored as ``site=…/crawl=…`` folders; only the asked ones are read."""
    lines = spark.read.text(path).select("value", "site", "crawl")
    if site:
        lines = lines.filter(F.col("site") == site)
    if crawl:
        lines = lines.filter(F.col("crawl") == crawl)
    return _numbered(lines, partitions)


def write_index_table(lines: DataFrame, path: str) -> None:
    """Index lines (site, crawl, value) as gzip text by site and crawl."""
    lines.select("site", "crawl", "value").write.partitionBy("site", "crawl").option("compression", "gzip").mode(
        "errorifexists"
    ).text(path)


def usable() -> Column:
    """HTML pages fetched with status 200; a missing field rejects the row."""
    return F.col("mime").eqNullSafe("text/html") & F.col("status").eqNullSafe("200")


def dedup_index(index: DataFrame, order_col: str = "line_no") -> DataFrame:
    """The row to fetch per host and path: newest crawl, then file order."""
    row = F.struct(*index.columns)
    rank = F.struct(F.col("crawl"), (-F.col(order_col)).alias("_o"))
    return (
        index.filter(usable())
        .groupBy(index_hostpath("url").alias("hostpath"))
        .agg(F.max_by(row, rank).alias("_row"))
        .select("hostpath", "_row.*")
    )


def label_outcomes(index: DataFrame, order_col: str = "line_no") -> DataFrame:
    """Every index row with the outcome of filtering and deduplication.

    The kept row per key is found by an aggregate, stored and joined back, so
    no task holds a whole group; adaptive execution splits a hot key's rows.
    """
    rows = index.withColumn("hostpath", index_hostpath("url"))
    first = F.struct(F.col("crawl"), (-F.col(order_col)).alias("o"))
    kept = rows.filter(usable()).groupBy("hostpath").agg(F.max(first).alias("_kept"))
    kept = persist_table(kept, "kept-rows")
    joined = rows.join(kept, "hostpath", "left")
    outcome = (
        F.when(~F.col("mime").eqNullSafe("text/html"), "mime")
        .when(~F.col("status").eqNullSafe("200"), "status")
        .when((F.col("crawl") == F.col("_kept.crawl")) & (-F.col(order_col) == F.col("_kept.o")), "kept")
        .when(F.col("crawl") == F.col("_kept.crawl"), "dup_cdx")
        .otherwise("dup_all")
    )
    return joined.withColumn("outcome", outcome).drop("_kept")


def outcome_counts(index: DataFrame) -> DataFrame:
    """(outcome, n, percent), from counts per key and crawl alone.

    A key's rows in its newest crawl beyond the first are duplicates within a
    file; its rows in older crawls are duplicates across files.
    """
    fits = usable()
    failed = (
        F.when(~F.col("mime").eqNullSafe("text/html"), "mime").when(~F.col("status").eqNullSafe("200"), "status")
    )
    per_crawl = (
        index.select(failed.alias("failed"), F.when(fits, index_hostpath("url")).alias("hostpath"), F.when(fits, F.col("crawl")).alias("crawl"))
        .groupBy("failed", "hostpath", "crawl")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_key = per_crawl.groupBy("failed", "hostpath").agg(
        F.sum("n").alias("n"), F.max_by("n", "crawl").alias("n_newest")
    )
    split = F.when(
        F.col("failed").isNotNull(), F.array(F.struct(F.col("failed").alias("outcome"), F.col("n").alias("n")))
    ).otherwise(
        F.array(
            F.struct(F.lit("kept").alias("outcome"), F.lit(1).cast("bigint").alias("n")),
            F.struct(F.lit("dup_cdx").alias("outcome"), (F.col("n_newest") - 1).alias("n")),
            F.struct(F.lit("dup_all").alias("outcome"), (F.col("n") - F.col("n_newest")).alias("n")),
        )
    )
    counts = (
        per_key.select(F.inline(split).alias("outcome", "n"))
        .groupBy("outcome")
        .agg(F.sum("n").alias("n"))
        .filter("n > 0")
    )
    # At most five rows are left, so one window over all of them is safe.
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def fetch_plan(index: DataFrame, partitions: int | None = None) -> DataFrame:
    """Byte ranges to read, rows of one archive file next to each other.

    Spread by file and place within it, so a file holding most rows is read
    by many tasks, each walking forward through its own stretch.
    """
    plan = index.withColumns({"range_start": F.col("offset"), "range_end": F.col("offset") + F.col("length") - 1})
    by = ("filename", "range_start")
    spread = plan.repartitionByRange(partitions, *by) if partitions else plan.repartitionByRange(*by)
    return spread.sortWithinPartitions(*by)


def worker_label(n: int, *cols: str) -> Column:
    """Reproducible even split into ``n`` parts without any global order."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def parse_block_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Sparse block index lines, blank-separated: surt, time, file, offset, length."""
    keep = [c for c in lines.columns if c != line_col]
    f = F.split(F.btrim(line_col), r"\s+")
    return lines.select(
        *keep,
        F.get(f, F.lit(0)).alias("surt"),
        F.get(f, F.lit(2)).alias("file"),
        F.get(f, F.lit(3)).cast("bigint").alias("offset"),
        F.get(f, F.lit(4)).cast("bigint").alias("length"),
    )


def read_block_index(spark: SparkSession, path: str) -> DataFrame:
    """``<path>/<crawl>/indexes/cluster.idx`` files with their crawl."""
    lines = spark.read.text(path).select(
        "value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/indexes/[^/]*\z", 1).alias("crawl")
    )
    return parse_block_lines(lines)


def select_blocks(blocks: DataFrame, prefix: str, keys: tuple[str, ...] = ("crawl",)) -> DataFrame:
    """Blocks that may hold keys starting with ``prefix``.

    A block starts at its ``surt`` and ends where the next one starts. Blocks
    starting inside the prefix all qualify; of those starting before it only
    the last can reach in. That one is found as a maximum per crawl, which
    needs no sort and no window over a crawl's blocks.
    """
    inside = blocks.filter(F.col("surt").startswith(prefix))
    before = blocks.filter(F.col("surt") < F.lit(prefix))
    fields = [c for c in blocks.columns if c not in keys]
    last = before.groupBy(*keys).agg(F.max_by(F.struct(*fields), "surt").alias("_b")).select(*keys, "_b.*")
    return inside.unionByName(last).distinct()
