"""Text rollups as stored tables: one folder per batch, language and month, sorted by term.

A row holds the documents of its group as a count and as a theta sketch, so one table
serves counting, ratio and co-occurrence requests. Requests name a language, a span of
time and a few terms: the first two choose folders, the terms choose row groups.

Batches are added without touching what is stored; a batch that is run again replaces
its own folder. Opening merges them (counts add, sketches unite); compacting writes the
merged rows as one batch of a new table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import sketches as sk
from ..session import folders_open, shuffles_dropped, sorted_aggregates
from . import textrollups as tr
from .textrollups import dealt_runs as _dealt  # noqa: F401

_FILES: dict[tuple, str] = {}
#: How files are written: terms by what they share with the one before, in groups that a lookup can skip.
FILES = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(32 << 20)}
#: Folders that a task of dealt rows writes side by side; beyond, it sorts what is left by folder.
DEALT_FOLDERS = 256


def _keys(terms: bool, by_host: bool) -> list[str]:
    return (["alltext"] if terms else []) + ["language"] + (["host"] if by_host else [])


def _schema(unit: str, terms: bool, by_host: bool) -> str:
    own = [f"{k} string" for k in _keys(terms, by_host) if k != "language"]
    own += [f"{tr.time_key(unit)} timestamp"] if unit != "month" else []
    return ", ".join([*own, "docs bigint", f"{tr.DOCS} binary", "several binary", "batch int", "language string", "period date"])


def write_batch(rollup: DataFrame, path: str, unit: str = "month", batch: int = 0, dealt: bool = False) -> str:
    """Store rows of ``build`` as one batch of the table at ``path``, in place of an earlier run of it.

    Rows are dealt by ranges of (language, month, term), so a folder gets the files of
    few tasks and a folder too large for one task gets several. Those of ``build`` with
    terms are ``dealt`` and in order already, and are neither moved nor sorted again. A null
    language or time has a folder of its own; an empty language is null. Sketches of several
    documents have a column of their own, so that those of one, few in a folder, are stored by number.
    """
    time, spark = tr.time_key(unit), rollup.sparkSession
    order = ["language", "period"] + (["alltext"] if "alltext" in rollup.columns else [])
    several = F.col("docs") > 1
    rows = rollup.withColumns({
        "period": F.trunc(F.col(time).cast("date"), "month"), "several": F.when(several, F.col(tr.DOCS)), tr.DOCS: F.when(~several, F.col(tr.DOCS)),
    })
    rows = rows.drop(time) if unit == "month" else rows
    rows = rows if dealt else rows.repartitionByRange(*order).sortWithinPartitions(*order)
    with sorted_aggregates(spark), shuffles_dropped(spark), folders_open(spark, DEALT_FOLDERS if dealt else 0):
        out = rows.write.mode("overwrite").options(**FILES).partitionBy("language", "period")
        out.parquet(f"{path}/batch={batch}")
    return path


def build(
    articles: DataFrame, unit: str = "month", terms: bool = False, by_host: bool = False, max_n: int = 3, vectors: tr.Vectors | None = None
) -> DataFrame:
    """Documents per (term,) language, time (, host): ``docs`` and a theta sketch of their keys.

    ``vectors`` and how terms are counted: see :func:`textrollups.count_terms`. Their rows
    lie in tasks by language and month, and there, within a share of the terms, in order.
    """
    keys = _keys(terms, by_host) + [tr.time_key(unit)]
    if not terms:
        rows = tr.keyed(articles, unit, terms, max_n)
        return rows.groupBy(*keys).agg(F.count(tr.DOCS).alias("docs"), sk.theta_build(tr.DOCS).alias(tr.DOCS)).select(*keys, "docs", tr.DOCS)
    return tr.count_terms(articles, unit, by_host, max_n, vectors).select(*keys, "docs", tr.DOCS)


def open_store(
    spark: SparkSession, path: str, unit: str = "month", terms: bool = False, by_host: bool = False, merged: bool = False, lo: str | None = None, hi: str | None = None
) -> DataFrame:
    """The stored rollup as ``build`` gives it. ``merged``: it is known to be of one batch.

    Filters on language, term and, by months, on time pass through the merge to the
    files. ``lo`` and ``hi`` read only the months from the one's to the other's.
    """
    time = tr.time_key(unit)
    rows = spark.read.schema(_schema(unit, terms, by_host)).parquet(path).withColumn(tr.DOCS, F.coalesce(tr.DOCS, "several"))
    if lo is not None:
        rows = rows.filter(F.col("period") >= F.trunc(F.lit(lo).cast("date"), "month"))
    if hi is not None:
        rows = rows.filter(F.col("period") <= F.lit(hi).cast("date"))
    rows = rows.withColumn(time, F.col("period").cast("timestamp")) if unit == "month" else rows
    keys = _keys(terms, by_host) + [time]
    if merged:
        return rows.select(*keys, "docs", tr.DOCS)
    return rows.groupBy(*keys).agg(F.sum("docs").alias("docs"), sk.theta_merge(tr.DOCS).alias(tr.DOCS))


def compact(spark: SparkSession, path: str, target: str, unit: str = "month", terms: bool = False, by_host: bool = False) -> str:
    """Write all batches of ``path`` as the one batch of a new table."""
    return write_batch(open_store(spark, path, unit, terms, by_host), target, unit)


def counts(store: DataFrame) -> DataFrame:
    """An opened store with the count in place of the sketch, as the count rollups have it."""
    return store.drop(tr.DOCS).withColumnRenamed("docs", tr.DOCS)


def once(spark: SparkSession, name: tuple, make: Callable[[], str]) -> str:
    """The path that ``make`` returned the first time this application asked for ``name``."""
    key = (spark.sparkContext.applicationId, *name)
    if key not in _FILES:
        _FILES[key] = make()
    return _FILES[key]
