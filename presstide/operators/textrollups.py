"""Document-frequency rollups of articles by language, time, host and n-gram.

Input is an article view with ``hostpath_surt``, ``language``,
``timestamp_published`` and, for the n-gram family, ``tokens`` (title and
content vectors already joined).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import sketches as sk
from ..functions import text as tx
from ..functions import urlkeys as uk
from ..session import persist_table

UNITS = ("month", "day")
DOCS = "hostpath_surt"
#: Articles whose n-grams one task takes, on average.
ARTICLES_A_TASK = 2000
#: Times as many articles of one language and month that a task takes whole, for a share of their terms.
FOLDER_TASKS = 5
#: Shares of a month's terms to each of which its texts go whole; beyond, runs of words move.
WHOLE_SHARES = 3
#: Shares of a month's terms that one task takes, on average, as runs of words.
SHARES_A_TASK = 4
#: Sketches of a term that are united at once.
SKETCHES = 32
#: Adds the token vectors of articles.
Vectors = Callable[[DataFrame], DataFrame]


def time_key(unit: str) -> str:
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    return f"timestamp_published_{unit}"


def keyed(articles: DataFrame, unit: str, terms: bool, max_n: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """One row per article, or per article and distinct n-gram, with the group keys.

    N-grams are made distinct inside the row before they are exploded, so a
    term counts a document once and no shuffle is needed for that. Columns to
    ``keep`` go with every row.
    """
    out = articles.select(
        "language",
        F.date_trunc(unit.upper(), "timestamp_published").alias(time_key(unit)),
        uk.url_host(uk.unsurt(DOCS)).alias("host"),
        DOCS,
        *keep,
        *(["tokens"] if terms else []),
    )
    return tx.explode_ngrams(out, "tokens", "alltext", max_n) if terms else out


def term_tasks(articles: DataFrame) -> int:
    """How many tasks the n-grams of these articles are dealt to; each then sorts its own in memory."""
    return max(-(-articles.count() // ARTICLES_A_TASK), int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _folders(articles: DataFrame) -> DataFrame:
    """How many articles each language and month has, stored."""
    month = F.date_trunc("MONTH", "timestamp_published")
    return persist_table(articles.groupBy(F.col("language").alias("_language"), month.alias("_month")).agg(F.count(F.lit(1)).alias("_n")), "folders")


def _in_folders(articles: DataFrame, folders: DataFrame) -> DataFrame:
    month = F.date_trunc("MONTH", "timestamp_published")
    return articles.join(folders, F.col("language").eqNullSafe(F.col("_language")) & month.eqNullSafe(F.col("_month")))


def dealt_runs(articles: DataFrame, unit: str, max_n: int, folders: DataFrame | None = None) -> DataFrame:
    """N-grams of the articles by language, month and ``_share`` of the terms, a task having those of some ``ARTICLES_A_TASK``.

    Several shares meet in a task, so that tasks are alike however the shares fall.
    """
    folders = _folders(articles) if folders is None else folders
    folders = folders.withColumn("_shares", F.ceil(F.col("_n") * SHARES_A_TASK / ARTICLES_A_TASK))
    rows = keyed(_in_folders(articles, folders), unit, False, keep=("_month", "_shares", "tokens"))
    return tx.explode_shares(rows, "tokens", "_shares", max_n).repartition(term_tasks(articles), "language", "_month", "_share")


def count_terms(
    articles: DataFrame, unit: str, by_host: bool, max_n: int = 3, vectors: Vectors | None = None, sketch: bool = True, family: bool = False
) -> DataFrame:
    """Documents per term, language, time (, host): ``docs`` and, if asked, a theta sketch of their keys.

    Nearly every n-gram stands in one document of its month, so there is little to add up
    before a shuffle, and n-grams take many times their texts. So texts move, once, to
    the task of their language and month, and become n-grams there, which are counted on
    numbers, in order, in Arrow batches. Of a month with more articles than a task takes
    at once, several tasks have all texts, each for a share of the terms; of one with very
    many, articles' n-grams move by shares of the terms, as runs of words.

    ``vectors`` adds the ``tokens`` of articles without them, where these have moved. An
    article's sketch is made once a share: a term that one article has takes it as it is,
    another term the union of its articles'. ``family``: rows with host and rows without, told by ``by_host``.
    """
    time, group = time_key(unit), ["language", "_month", "_share"]
    own = [time, *(["host"] if by_host or family else [])]
    sets = [own, [time]] if family else [own]
    folders = _folders(articles).withColumn("_parts", F.ceil(F.col("_n") / (ARTICLES_A_TASK * FOLDER_TASKS)))
    count = F.sum("_n").alias("n"), F.coalesce(F.max("_parts"), F.lit(0)).alias("most")
    n, most = folders.agg(*count).first()

    def with_sketch(rows):
        # Equal addresses have one sketch.
        rows = rows.withColumn("_doc", F.col(DOCS).isNotNull().cast("int"))
        return rows.withColumn("_sketch", sk.theta_build(DOCS).over(Window.partitionBy(*group, DOCS))) if sketch else rows.sortWithinPartitions(*group)

    def rolled(rows, held, ngrams):
        rows = rows.select(*group, *own, "_doc", *(["_sketch"] if sketch else []), *held)
        types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        schema = ", ".join([
            "alltext string", *(f"{k} {types[k]}" for k in ["language", *own]), "docs bigint, by_host boolean",
            *(["_one binary", "_more array<array<binary>>"] if sketch else []),
        ])
        return rows.groupBy(*group).applyInArrow(_added_up(own, sets, ngrams, sketch), schema)

    tasks = max(-(-(n or 0) // ARTICLES_A_TASK), int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole = _in_folders(articles, folders.filter(F.col("_parts") <= WHOLE_SHARES))
    whole = whole.withColumns({
        time: F.date_trunc(unit.upper(), "timestamp_published"), "host": uk.url_host(uk.unsurt(DOCS)),
        "_share": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)),
    })
    whole = with_sketch(whole.repartition(tasks, *group))
    whole = whole if vectors is None else vectors(whole)
    out = rolled(whole, ("tokens", "_parts"), lambda b: tx.ordered_ngrams(b["tokens"], max_n, b["_parts"][0].as_py(), b["_share"][0].as_py()))
    if most > WHOLE_SHARES:
        large = folders.filter(F.col("_parts") > WHOLE_SHARES).drop("_parts")
        runs = with_sketch(dealt_runs(articles if vectors is None else vectors(articles), unit, max_n, large))
        out = out.unionByName(rolled(runs, ("_words", "_runs"), lambda b: tx.runs_in_order(b["_words"], b["_runs"], max_n)))
    merged = [F.coalesce("_one", sk.theta_merge_lists("_more")).alias(DOCS)] if sketch else []
    return out.select("alltext", "language", *own, "docs", *merged, *(["by_host"] if family else []))


def _added_up(own: list[str], sets: list[list[str]], ngrams: Callable, sketch: bool):
    """For a share's rows: for each of ``sets``, a row per term and values of its columns, with its articles'
    number and sketch; where they are several, their sketches by lists of ``SKETCHES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        (batch,) = pa.Table.from_batches(list(batches)).combine_chunks().to_batches()
        n_rows = batch.num_rows
        is_doc = batch["_doc"].to_numpy(zero_copy_only=False).astype(np.int64)
        places = []
        for columns in sets:
            place = np.zeros(n_rows, np.int64)
            for k in columns:
                coded = batch[k].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                place = np.unique(place * n_rows + coded, return_inverse=True)[1]
            places.append((columns, place, np.unique(place, return_index=True)[1]))
        for names, number, row in ngrams(batch):
            for columns, place, shown in places if len(row) else ():
                gram, of = number, row
                if len(shown) > 1:
                    order = np.lexsort((row, place[row], number))
                    gram, of = number[order], row[order]
                new = np.ones(len(of), bool)
                new[1:] = (gram[1:] != gram[:-1]) | (place[of[1:]] != place[of[:-1]])
                start = np.flatnonzero(new)
                at = pa.array(shown[place[of[start]]])
                out = {"alltext": names.take(pa.array(gram[start])), "language": batch["language"].take(at)}
                for k in own:
                    out[k] = batch[k].take(at) if k in columns else pa.nulls(len(start), batch[k].type)
                out["docs"] = pa.array(np.add.reduceat(is_doc[of], start))
                out["by_host"] = pa.array(np.full(len(start), "host" in columns))
                if sketch:
                    size = np.diff(start, append=len(of))
                    # The rows of terms that several rows have, and where their lists begin.
                    several = np.repeat(size > 1, size)
                    inner = (np.arange(len(of)) - np.repeat(start, size))[several] % SKETCHES == 0
                    lists = pa.array(np.append(np.flatnonzero(inner), len(inner)).astype(np.int32))
                    lists = pa.ListArray.from_arrays(lists, batch["_sketch"].take(pa.array(of[several])))
                    n_lists = np.where(size > 1, -(-size // SKETCHES), 0)
                    out["_one"] = batch["_sketch"].take(pa.array(of[start], mask=size > 1))
                    out["_more"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_lists)]).astype(np.int32)), lists)
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def text_rollup(
    articles: DataFrame,
    unit: str = "month",
    terms: bool = False,
    by_host: bool = False,
    sketch: bool = False,
    max_n: int = 3,
    vectors: Vectors | None = None,
) -> DataFrame:
    """Documents per (term,) language, time (, host); a count or a theta sketch. ``vectors`` as in :func:`count_terms`."""
    if terms:
        rows = count_terms(articles, unit, by_host, max_n, vectors, sketch)
        return rows.drop("docs") if sketch else rows.withColumnRenamed("docs", DOCS)
    keys = ["language", time_key(unit)] + (["host"] if by_host else [])
    measure = sk.theta_build(DOCS) if sketch else F.count(DOCS)
    return keyed(articles, unit, False).groupBy(*keys).agg(measure.alias(DOCS))


def text_rollup_family(
    articles: DataFrame, unit: str = "month", terms: bool = False, max_n: int = 3, vectors: Vectors | None = None
) -> DataFrame:
    """With-host and without-host rollups: counts plus sketches.

    ``by_host`` marks which of the two a row belongs to. With terms, both are added up
    where the articles have moved; without, those without host from those with it.
    """
    base = ["language", time_key(unit)]
    if terms:
        return count_terms(articles, unit, True, max_n, vectors, family=True).select("alltext", *base, "host", "docs", DOCS, "by_host")
    per_host = keyed(articles, unit, False).groupBy(*base, "host").agg(F.count(DOCS).alias("docs"), sk.theta_build(DOCS).alias(DOCS))
    whole = per_host.groupBy(*base).agg(F.sum("docs").alias("docs"), sk.theta_merge(DOCS).alias(DOCS))
    whole = whole.select(*base, F.lit(None).cast("string").alias("host"), "docs", DOCS, F.lit(False).alias("by_host"))
    return per_host.withColumn("by_host", F.lit(True)).unionByName(whole)
