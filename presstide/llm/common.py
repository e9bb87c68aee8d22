"""Helpers shared by the operators: column choice and word arrays inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import persist_table, scratch_dir  # noqa: F401

WORD = "[^\\x20\\x09-\\x0D]+"
#: Text a task works on at once. Bounds memory, not results: a longer text is a slice of its own.
SLICE_CHARS = 1 << 21
_MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores after it until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only what an operator reads, under fixed names; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about ``most`` bytes of text."""
    size = pc.fill_null(pc.binary_length(batch[text_col]), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and where each text's words begin (one offset more than texts)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    if pa.types.is_large_list(lists.type):
        lists = lists.cast(pa.list_(lists.type.value_type))
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    ends = kept[np.concatenate([[0], np.cumsum(counts)])]
    return flat.filter(full), ends.astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of unsigned 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * _MIX
    return x ^ (x >> np.uint64(32))


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash for each word; a word that repeats is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    once = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return once[coded.indices.to_numpy(zero_copy_only=False)]
