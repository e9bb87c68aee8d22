"""Captures, their metadata documents and the deduplicated article view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions import scalars as sc
from ..functions import text as tx
from ..functions import urlkeys as uk
from ..session import persist_table

# The document keys that are read; everything else passes through unread.
DOC_SCHEMA = """
    author struct<best:struct<value:string>>,
    language struct<best:struct<value:string>>,
    title struct<best:struct<value:string>>,
    description struct<best:struct<value:string>>,
    type struct<best:struct<value:string>>,
    content struct<best:struct<value:struct<html:string,text:string>>>,
    `url.canonical` struct<best:struct<value:string>>,
    `timestamp.published` struct<best:struct<value:struct<lo:string,hi:string>>>,
    `timestamp.modified` struct<best:struct<value:struct<lo:string,hi:string>>>,
    `links.all` struct<best:struct<value:array<struct<href:string>>>>,
    `links.content` struct<best:struct<value:array<struct<href:string>>>>,
    version string,
    exception struct<`str(e)`:string,type:string,location:string,traceback:string>
"""


def typed_doc(json_text: Column | str) -> Column:
    """JSON text to a typed struct; unread keys are pruned by the optimizer."""
    return F.from_json(uk.as_col(json_text), DOC_SCHEMA)


def doc_value(doc: Column | str, *path: str) -> Column:
    """Nested value by exact key names, which may contain dots."""
    out = uk.as_col(doc)
    for key in path:
        out = out.getField(key)
    return out


def best(doc: Column | str, key: str, *path: str) -> Column:
    return doc_value(doc, key, "best", "value", *path)


def capture_facts(captures: DataFrame) -> DataFrame:
    """One flat row per capture with every column the rollups group or count.

    Only the columns a query uses are computed or, on stored tables, read.
    """
    doc = F.col("doc")
    published = best(doc, "timestamp.published")
    modified = best(doc, "timestamp.modified")
    return captures.select(
        "id",
        "id_source",
        "accessed_at",
        "inserted_at",
        "url",
        uk.url_host("url").alias("host"),
        uk.url_host_surt("url").alias("host_surt"),
        doc_value(doc, "version").alias("version"),
        best(doc, "type").alias("type"),
        best(doc, "language").alias("language"),
        sc.parse_time(published.getField("lo")).alias("published_lo"),
        F.when(published.isNotNull(), F.to_json(published)).alias("published"),
        F.when(modified.isNotNull(), F.to_json(modified)).alias("modified"),
        doc_value(doc, "exception", "type").alias("exception_type"),
        doc_value(doc, "exception", "location").alias("exception_location"),
    )


def drop_invalid(records: DataFrame, required: Sequence[str] = ("html", "url", "accessed_at")) -> DataFrame:
    """Records that have a body, an address and a time."""
    return records.dropna(subset=list(required))


def article_candidates(captures: DataFrame, stops: Mapping[str, Sequence[str]] = tx.DEFAULT_STOPS) -> DataFrame:
    """Captures that have every article field, projected to the article view.

    ``reject`` is null for an article and names the first missing field
    otherwise; a null description is allowed. The first two characters of the
    language choose the word list.
    """
    doc = F.col("doc")
    flat = captures.select(
        "id",
        "url",
        uk.url_hostpath_surt("url").alias("hostpath_surt"),
        best(doc, "language").alias("_language"),
        sc.language_iso639(best(doc, "language")).alias("language"),
        best(doc, "timestamp.published", "lo").alias("_lo"),
        sc.parse_time(best(doc, "timestamp.published", "lo")).alias("timestamp_published"),
        best(doc, "title").alias("title"),
        doc_value(doc, "description").isNull().alias("_no_description"),
        best(doc, "description").alias("description"),
        best(doc, "content", "html").alias("content"),
        best(doc, "content", "text").alias("_text"),
    )
    reject = (
        F.when(F.col("_language").isNull(), "language")
        .when(F.col("_lo").isNull(), "timestamp.published")
        .when(F.col("timestamp_published").isNull(), "timestamp.published unreadable")
        .when(F.col("title").isNull(), "title")
        .when(F.col("_no_description"), "description")
        .when(F.col("content").isNull(), "content")
        .when(F.col("_text").isNull(), "content text")
    )
    flat = flat.withColumn("reject", reject).withColumn("_code", F.substring("_language", 1, 2))
    flat = tx.with_tokens(flat, "title", "_code", "tsv_title", stops)
    flat = tx.with_tokens(flat, "_text", "_code", "tsv_content", stops)
    return flat.drop("_language", "_lo", "_no_description", "_text", "_code")


def to_articles(captures: DataFrame, stops: Mapping[str, Sequence[str]] = tx.DEFAULT_STOPS) -> DataFrame:
    return article_candidates(captures, stops).filter(F.col("reject").isNull()).drop("reject")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], latest: bool = False) -> DataFrame:
    """One whole row per key: the first, or latest, by ``order``.

    An aggregate, not a window: each task keeps one row per key before the
    shuffle, so a key holding a third of the table stays cheap.
    """
    pick = F.max_by if latest else F.min_by
    row = F.struct(*df.columns)
    chosen = pick(row, F.struct(*order)).alias("_row")
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(chosen).select("_row.*")


def latest_ties(df: DataFrame, key: str, ts: str) -> DataFrame:
    """All rows carrying the latest time of their key.

    The per-key maximum is aggregated first and joined back; adaptive
    execution splits a hot key's side of the join.
    """
    newest = df.groupBy(key).agg(F.max(ts).alias(ts))
    return df.join(newest, [key, ts], "left_semi")


def page_view(captures: DataFrame, url: str | None = None, id: int | None = None) -> DataFrame:
    """The newest capture of one page, asked for by address or by capture id."""
    wanted = uk.url_hostpath_surt("url") == uk.url_hostpath_surt(F.lit(url)) if url else F.col("id") == id
    return captures.filter(wanted).orderBy(F.col("accessed_at").desc_nulls_last(), F.col("id").desc()).limit(1)


#: Rows that one task settles in order once the rounds have left no more.
SETTLED_AT_ONCE = 50_000


def _settle(todo: DataFrame) -> DataFrame:
    """The rows of a small remainder that inserting in order keeps."""

    def run(batches):
        seen_a, seen_b = set(), set()
        for batch in batches:
            kept = []
            for row in batch.to_pylist():
                a, b = row["_a"], None if row["_b"] is None else tuple(row["_b"].values())
                if (a is None or a not in seen_a) and (b is None or b not in seen_b):
                    kept.append(row["_o"])
                    seen_a.add(a)
                    seen_b.add(b)
            yield pa.RecordBatch.from_arrays([pa.array(kept, batch.schema.field("_o").type)], ["_o"])

    ordered = todo.coalesce(1).sortWithinPartitions("_o")
    return ordered.mapInArrow(run, StructType([ordered.schema["_o"]]))


def first_wins(articles: DataFrame, order_col: str, host_col: str = "host", title_col: str = "title",
               key_col: str = "hostpath_surt") -> DataFrame:
    """Articles left by inserting in ``order_col`` order under two unique keys.

    A row is kept unless an earlier *kept* row has its ``key_col`` or its
    (host, title); null keys and null titles never conflict. Solved in parallel
    rounds: a row that is first in both of its groups is kept, rows sharing a
    key with a kept row leave, and the rest go on, until few are left, which one
    task settles in order. Every round keeps a row, so the rounds end. The
    result does not depend on how rows are spread. ``order_col`` must be unique.

    Rows that agree on both keys are reduced to the first up front, which
    takes exact copies out before any join, and rows that cannot conflict are
    kept at once; only keys and order take part until the end. Each round goes
    to the shared folder, so the plan stays short and a lost executor costs one
    round.
    """
    pair = F.when(F.col(title_col).isNotNull(), F.struct(F.col(host_col), F.col(title_col)))
    rows = articles.select(F.col(order_col).alias("_o"), F.col(key_col).alias("_a"), pair.alias("_b"))
    free = rows.filter("_a IS NULL AND _b IS NULL").select("_o")
    held = rows.filter("_a IS NOT NULL OR _b IS NOT NULL")
    todo = persist_table(held.groupBy("_a", "_b").agg(F.min("_o").alias("_o")), "first-wins")
    kept_parts = [free]
    while True:
        if todo.limit(SETTLED_AT_ONCE + 1).count() <= SETTLED_AT_ONCE:
            kept_parts.append(persist_table(_settle(todo), "first-wins-settled"))
            break
        # Each group has one possible winner, so both sides are unique here.
        first_a = todo.filter("_a IS NOT NULL").groupBy("_a").agg(F.min("_o").alias("_o")).select("_o")
        first_b = todo.filter("_b IS NOT NULL").groupBy("_b").agg(F.min("_o").alias("_o")).select("_o")
        free_a, free_b = todo.filter("_a IS NULL").select("_o"), todo.filter("_b IS NULL").select("_o")
        winners = first_a.unionByName(free_a).join(first_b.unionByName(free_b), "_o", "left_semi")
        kept = persist_table(todo.join(winners, "_o", "left_semi"), "first-wins-kept")
        kept_parts.append(kept.select("_o"))
        rest = todo.join(kept.filter("_a IS NOT NULL").select("_a"), "_a", "left_anti")
        todo = persist_table(rest.join(kept.filter("_b IS NOT NULL").select("_b"), "_b", "left_anti"), "first-wins-rest")
    kept = kept_parts[0]
    for part in kept_parts[1:]:
        kept = kept.unionByName(part)
    return articles.join(kept.select(F.col("_o").alias(order_col)), order_col, "left_semi").select(*articles.columns)


def insert_absent(new: DataFrame, existing: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """Rows of ``new`` that collide with no existing row on any of the keys.

    A key with a null part never collides. ``existing`` has each key once, as
    these very inserts see to, so its keys go into the join as they are.
    """
    out = new
    for key in keys:
        out = out.join(existing.select(*key).dropna(), list(key), "left_anti")
    return out.select(*new.columns)


def insert_articles(new: DataFrame, existing: DataFrame, order_col: str, host_col: str = "host", title_col: str = "title",
                    key_col: str = "hostpath_surt") -> DataFrame:
    """Rows of ``new`` that inserting them one by one into ``existing`` keeps.

    ``existing`` has each key once. First what collides with it leaves, then the
    rest is settled among itself: a row that collides with no stored row may
    still collide with an earlier new one.
    """
    absent = insert_absent(new, existing, [[key_col], [host_col, title_col]])
    return first_wins(absent, order_col, host_col, title_col, key_col)


def summary_document(df: DataFrame, variant_col: str, drop: Sequence[str] = ("version", "process_time")) -> DataFrame:
    """Flatten an opaque document: ``best.value`` per key, else the value itself.

    A key whose ``best`` is JSON null is left out. Adds ``summary``, a map of
    JSON texts; no shuffle, each row by itself.
    """
    entries = F.map_entries(F.expr(f"CAST({variant_col} AS MAP<STRING, VARIANT>)"))

    def has_best(v):
        return F.try_variant_get(v, "$.best", "variant").isNotNull()

    kept = F.filter(
        entries,
        lambda e: ~e["key"].isin(list(drop))
        & ~F.coalesce(F.is_variant_null(F.try_variant_get(e["value"], "$.best", "variant")), F.lit(False)),
    )
    flat = F.transform(
        kept,
        lambda e: F.struct(
            e["key"].alias("key"),
            F.to_json(
                F.when(has_best(e["value"]), F.try_variant_get(e["value"], "$.best.value", "variant")).otherwise(e["value"])
            ).alias("value"),
        ),
    )
    return df.withColumn("summary", F.map_from_entries(flat))


def display_fields(captures: DataFrame) -> DataFrame:
    """The six fixed fields of a capture page, empty where missing.

    A time that spans a while is shown from its lower to its upper end,
    ``lo/hi``; one without length, or with one end known, as that alone.
    """
    doc = F.col("doc")

    def shown(c):
        return F.coalesce(c.cast("string"), F.lit(""))

    def span(key):
        ends = F.array_compact(F.array(best(doc, key, "lo"), best(doc, key, "hi")))
        return shown(F.array_join(F.array_distinct(ends), "/"))

    return captures.select(
        "id",
        "accessed_at",
        "url",
        shown(best(doc, "author")).alias("author"),
        span("timestamp.published").alias("timestamp.published"),
        span("timestamp.modified").alias("timestamp.modified"),
        shown(best(doc, "url.canonical")).alias("url.canonical"),
        shown(best(doc, "language")).alias("language"),
        F.lit("").alias("version"),
    )
