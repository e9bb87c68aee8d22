"""Stored tables: batch appends with a ledger, archives and stored rollups.

Each batch owns one folder per table and overwrites it when replayed, so a
batch that is run twice, or half-written by a lost job, leaves one copy.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import urlkeys as uk
from . import captures as cp
from . import rollups as ru

LEDGER_SCHEMA = "source string, urls_inserted bigint, finished_at timestamp, kind string, batch bigint"


def _stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table at ``path``, or None before its first batch."""
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def unfinished(batch: DataFrame, batch_id: int, ledger_path: str, source_col: str = "id_source") -> DataFrame:
    """Rows of ``batch`` whose source was not finished before this batch."""
    rows = _stored(batch.sparkSession, ledger_path, LEDGER_SCHEMA)
    if rows is None:
        return batch
    done = rows.filter((F.col("kind") == "finish") & (F.col("batch") < batch_id)).select(F.col("source").alias("_done")).distinct()
    return batch.join(done, F.col(source_col).cast("string") == F.col("_done"), "left_anti")


def append_articles(captures: DataFrame, batch_id: int, articles_path: str) -> None:
    """Insert a batch's captures into the article view, in the order of their ids.

    An article enters if no earlier batch has its page or its (host, title), and
    no earlier article of the batch. A replay is held against the same batches.
    """
    rows = cp.to_articles(captures).withColumn("host", uk.url_host(uk.unsurt("hostpath_surt")))
    earlier = _stored(captures.sparkSession, articles_path)
    if earlier is None:
        new = cp.first_wins(rows, "id")
    else:
        new = cp.insert_articles(rows, earlier.filter(F.col("batch") < batch_id), "id")
    new.write.mode("overwrite").parquet(f"{articles_path}/batch={batch_id}")


def append_batch(
    batch: DataFrame, batch_id: int, captures_path: str, ledger_path: str, source_col: str = "id_source", articles_path: str | None = None
) -> None:
    """Append captures, then record how many each source got in this batch, then the articles.

    Ledger and articles are made from the stored captures, so they always agree
    with them.
    """
    target = f"{captures_path}/batch={batch_id}"
    batch.write.mode("overwrite").parquet(target)
    spark = batch.sparkSession
    stored = spark.read.schema(batch.schema).parquet(target)
    stored.groupBy(F.col(source_col).cast("string").alias("source")).agg(
        F.count(F.lit(1)).alias("urls_inserted"), F.lit(None).cast("timestamp").alias("finished_at")
    ).write.mode("overwrite").parquet(f"{ledger_path}/kind=append/batch={batch_id}")
    if articles_path is not None:
        append_articles(stored, batch_id, articles_path)


def finish_sources(spark: SparkSession, sources: DataFrame, ledger_path: str, batch_id: int) -> None:
    """Mark sources as completely loaded; apart from the counts of a batch with this id."""
    sources.select(
        F.col("source").cast("string"),
        F.lit(0).cast("bigint").alias("urls_inserted"),
        F.current_timestamp().alias("finished_at"),
    ).distinct().write.mode("overwrite").parquet(f"{ledger_path}/kind=finish/batch={batch_id}")


def read_ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    """One row per source: pages inserted so far and when it was finished."""
    rows = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path)
    return rows.groupBy("source").agg(
        F.sum("urls_inserted").alias("urls_inserted"), F.max("finished_at").alias("finished_at")
    )


def pending(discovered: DataFrame, ledger: DataFrame) -> DataFrame:
    """Discovered sources that are not finished, with what they have so far."""
    state = ledger.select("source", "urls_inserted", "finished_at")
    return (
        discovered.join(state, "source", "left")
        .filter("finished_at IS NULL")
        .select(*discovered.columns, F.coalesce("urls_inserted", F.lit(0)).alias("urls_inserted"))
    )


def write_archive(records: DataFrame, path: str, force: bool = False) -> None:
    """Records by site and crawl; refuses to replace unless ``force``.

    Rebalancing brings a site's rows together, so each folder gets few files,
    and cuts a site too large for one task into several.
    """
    mode = "overwrite" if force else "errorifexists"
    records.hint("rebalance", "surt", "crawl").write.partitionBy("surt", "crawl").mode(mode).parquet(path)


def store_rollup(df: DataFrame, spec: ru.RollupSpec, path: str) -> None:
    """Write the sketches, sorted by key so that lookups skip files."""
    ru.build(df, spec).sortWithinPartitions(*spec.keys).write.mode("errorifexists").parquet(path)


def open_rollup(spark: SparkSession, spec: ru.RollupSpec, path: str, with_rows: bool = False) -> DataFrame:
    """The finished view over a stored rollup."""
    return ru.finalize(spark.read.parquet(path), spec, with_rows)
