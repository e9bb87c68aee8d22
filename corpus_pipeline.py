"""From raw documents to packed training sequences.

Each stage takes what the one before it kept, written as Parquet and read again.
All but the last return the columns of ``documents``. A null or empty text has no
words: it is scored, is no near-duplicate, holds no secret, and the mix never takes
it. A row without an id is no near-duplicate of another; to the mix and the packing
null is one more id. Of rows that share an id near-dedup keeps one at most. Ties are
broken by hashes of id and text, so reruns agree. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from presstide.llm import minhash_dedup, mixing, packing, quality_fm, secret_scan
from presstide.llm.common import persist_table, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, keeps."""
    return quality_fm.keep(docs, quality_fm.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash_dedup.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found in a text replaced by a mark."""
    return secret_scan.redact(docs, length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_duplicates),
    ("secret scan", secrets),
    ("source mixing", mix),
    ("packing", pack),
]

#: A factorisation machine and a tokenizer have no SQL; tests/llm holds the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persist_table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
