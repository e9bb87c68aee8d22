"""Inverted index over token vectors: boolean and phrase match, ranking, hits.

The index is a plain table of positions, one row per token. Building it is a
projection, without a shuffle; stored sorted by term it is read only where the
query's terms are. Every match step is an aggregate over the few terms' rows,
so nothing is compared document by document and no document's or term's rows
are gathered into one value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as sc
from ..functions import text as tx
from ..functions import urlkeys as uk

BM25_K1 = 1.2
BM25_B = 0.75
ORDERINGS = ("none", "time_desc", "time_asc", "rank")


def build_index(articles: DataFrame, id_col: str = "id", tokens_col: str = "tsv_content") -> DataFrame:
    """Positions (term, doc, pos, doc_len)."""
    vectors = articles.select(F.col(id_col).alias("doc"), tokens_col, F.size(tokens_col).alias("doc_len"))
    return tx.explode_tokens(vectors, tokens_col, "doc", "doc_len").select(
        F.col("lexeme").alias("term"), "doc", "pos", "doc_len"
    )


def term_counts(index: DataFrame) -> DataFrame:
    """Postings (term, doc, tf, doc_len) without the positions."""
    return index.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.max("doc_len").alias("doc_len"))


def write_index(index: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Store the index sorted by term; file statistics then serve as the lookup.

    Range partitioning on (term, doc) lets one frequent term span many files.
    """
    by = (F.col("term"), F.col("doc"))
    spread = index.repartitionByRange(partitions, *by) if partitions else index.repartitionByRange(*by)
    spread.sortWithinPartitions(*by, "pos").write.mode("errorifexists").parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def docs_with_all(index: DataFrame, terms: Sequence[str]) -> DataFrame:
    terms = list(dict.fromkeys(terms))
    hits = index.filter(F.col("term").isin(terms)).groupBy("doc")
    # A flag per term, not a distinct count: it aggregates before the shuffle.
    return hits.agg(
        *[F.max(F.col("term") == t).alias(f"has{i}") for i, t in enumerate(terms)]
    ).filter(reduce(and_, [F.col(f"has{i}") for i in range(len(terms))])).select("doc")


def docs_with_any(index: DataFrame, terms: Sequence[str]) -> DataFrame:
    return index.filter(F.col("term").isin(list(terms))).select("doc").distinct()


def docs_with_phrase(index: DataFrame, phrase: Sequence[str]) -> DataFrame:
    """Documents where the words follow each other directly.

    Each position votes for the start it implies, under every place its word
    has in the phrase; a start with a vote for every place is an occurrence.
    """
    places = {}
    for i, word in enumerate(phrase):
        places.setdefault(word, []).append(F.lit(i))
    offsets = None
    for word, at in places.items():
        offsets = F.when(F.col("term") == word, F.array(*at)) if offsets is None else offsets.when(
            F.col("term") == word, F.array(*at)
        )
    votes = (
        index.filter(F.col("term").isin(list(places)))
        .select("doc", "pos", F.explode(offsets).alias("place"))
        .groupBy("doc", (F.col("pos") - F.col("place")).alias("start"))
        .agg(F.size(F.collect_set("place")).alias("_places"))
    )
    # A start gathers no more places than the phrase has words.
    return votes.filter(F.col("_places") == len(phrase)).select("doc").distinct()


def match(
    index: DataFrame,
    all_of: Sequence[str] = (),
    any_of: Sequence[str] = (),
    none_of: Sequence[str] = (),
    phrases: Sequence[Sequence[str]] = (),
    every: DataFrame | None = None,
) -> DataFrame | None:
    """Documents satisfying every given part; None when nothing is asked for.

    ``every`` holds all documents (doc), also those without a token, which the
    index does not know; it is needed where only words to avoid are given.
    """
    parts = [docs_with_phrase(index, p) if len(p) > 1 else docs_with_all(index, p) for p in phrases if p]
    if all_of:
        parts.append(docs_with_all(index, all_of))
    if any_of:
        parts.append(docs_with_any(index, any_of))
    if not parts and not none_of:
        return None
    if not parts and every is None:
        raise ValueError("with none_of alone, pass every document")
    docs = parts[0] if parts else every.select("doc")
    for part in parts[1:]:
        docs = docs.join(part, "doc", "left_semi")
    if none_of:
        docs = docs.join(docs_with_any(index, none_of), "doc", "left_anti")
    return docs


def corpus_stats(articles: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length. Store it with the index."""
    return articles.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("doc_len").alias("mean"))


def bm25_part(n: Column, mean: Column, df: Column, tf: Column, doc_len: Column) -> Column:
    """One word's share of a document's score."""
    # ln(1 + (n - df + 0.5) / (df + 0.5)), rearranged to name df once.
    idf = F.log((n + 1) / (df + 0.5))
    return idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * doc_len / mean))


def bm25(index: DataFrame, stats: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(doc, score) for documents with any of the terms.

    The corpus figures of :func:`corpus_stats` and each term's document
    frequency enter as scalars, so scoring reads the terms' rows only.
    """
    terms = list(dict.fromkeys(terms))
    hits = term_counts(index.filter(F.col("term").isin(terms)))
    found = hits.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    # One scalar for all terms: as many entries as the query has.
    counts = found.agg(F.map_from_entries(F.collect_list(F.struct("term", "df")))).scalar()
    corpus = stats.select(F.struct("n", "mean")).scalar()
    n, mean = corpus["n"], corpus["mean"]
    df = F.try_element_at(counts, F.col("term"))
    part = bm25_part(n, mean, df, F.col("tf").cast("double"), F.col("doc_len"))
    return hits.groupBy("doc").agg(F.sum(part).alias("score"))


def on_sites(key: Column | str, hosts: Sequence[str]) -> Column:
    """The article's host is one of ``hosts`` exactly, subdomains excluded."""
    site = F.concat(F.split_part(uk.as_col(key), F.lit(")"), F.lit(1)), F.lit(")"))
    wanted = None
    for host in hosts:
        same = site == uk.url_host_surt(F.lit(host))
        wanted = same if wanted is None else wanted | same
    return wanted


def hit_columns(articles: DataFrame) -> list[Column]:
    """What a hit shows; the description is null where the view has none."""
    described = F.col("description") if "description" in articles.columns else F.lit(None).cast("string").alias("description")
    return [
        F.col("id"),
        uk.unsurt("hostpath_surt").alias("url"),
        uk.url_host(uk.unsurt("hostpath_surt")).alias("host"),
        F.col("title"),
        described,
        F.col("language"),
        F.to_date("timestamp_published").alias("date_published"),
    ]


def search(
    articles: DataFrame,
    index: DataFrame,
    all_of: Sequence[str] = (),
    phrases: Sequence[Sequence[str]] = (),
    none_of: Sequence[str] = (),
    sites: Sequence[str] = (),
    lo: str = "1980-01-01",
    hi: str = "2022-01-01",
    orderby: str = "none",
    k: int = 10,
    offset: int = 0,
    stats: DataFrame | None = None,
) -> DataFrame:
    """The first ``k`` hits in one of four orders, ties broken by key.

    ``articles`` are the article view with ``doc_len``, ``index`` its index;
    both are read several times and so should be stored tables. ``rank`` is a distance, 1/score: the best hit has the smallest.
    """
    if orderby not in ORDERINGS:
        raise ValueError(f"orderby must be one of {ORDERINGS}")
    hits = articles.filter(sc.time_in("timestamp_published", lo, hi))
    if sites:
        hits = hits.filter(on_sites("hostpath_surt", sites))
    every = articles.select(F.col("id").alias("doc"))
    docs = match(index, all_of=all_of, phrases=phrases, none_of=none_of, every=every)
    if docs is not None:
        hits = hits.join(docs.withColumnRenamed("doc", "id"), "id", "left_semi")
    words = list(dict.fromkeys([*all_of, *[w for p in phrases for w in p]]))
    if words:
        scored = bm25(index, corpus_stats(articles) if stats is None else stats, words).withColumnRenamed("doc", "id")
        hits = hits.join(scored, "id", "left").withColumn("rank", 1 / F.col("score"))
    else:
        hits = hits.withColumn("rank", F.lit(None).cast("double"))
    distance = sc.seconds_from("timestamp_published")
    order = {
        "none": [],
        "time_desc": [distance.desc()],
        "time_asc": [distance.asc()],
        "rank": [F.round("rank", 9).asc_nulls_last()],
    }[orderby]
    return hits.orderBy(*order, F.col("id").asc()).offset(offset).limit(k).select(*hit_columns(articles), "rank")


def parse_queries(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """Requests to (…, kind, term): phrases in quotes, ``site:`` filters, words.

    Words come out lower-case; one row per part, in the order of the text.
    """
    parts = F.regexp_extract_all(F.col(query_col), F.lit(r'"[^"]*"|[^\s"]+'), F.lit(0))

    def classify(p, i):
        low = F.lower(p)
        phrase = low.startswith('"')
        site = low.startswith("site:")
        kind = F.when(phrase, "phrase").when(site, "site").otherwise("word")
        term = F.when(phrase, F.btrim(low, F.lit('" '))).when(site, F.substr(low, F.lit(6))).otherwise(low)
        return F.struct((i + 1).alias("ord"), kind.alias("kind"), term.alias("term"))

    rest = [c for c in queries.columns if c != query_col]
    rows = queries.select(*rest, F.inline(F.transform(parts, classify)).alias("ord", "kind", "term"))
    return rows.filter(F.col("term") != "")
