"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

A unit vector o is rotated at random and only the signs of its coordinates are kept:
the code stands for the vector of +-1/sqrt(d) nearest to it, o'. With the correction
scalar c = <o', o>, <o', q> / c estimates <o, q> for a unit vector q without bias, and
its error stays below

    bound = errors * sqrt((1 - c^2) / (c^2 (d - 1)))

but for a chance that falls with the square of ``errors``. A query's own rotation is
kept in eight-bit steps, so <o', q> is a sum over bit planes of counts of common bits.
The vectors that look nearest are measured first; then those whose estimate plus bound
reaches the k-th best measure so far. The others are beyond it, but for that chance.

Queries go through all vectors in blocks: each block of vectors meets each block of
queries in one task, and hands on k neighbours per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import persist_table

#: Vectors coded together, and queries that meet them at once.
BLOCK, QUERIES = 2048, 512
#: Standard errors within which an estimate is trusted.
ERRORS = 3.0
PLANES = 8
#: Times k vectors are measured before the bound is applied.
FIRST = 6


def rotation(d: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal d x d matrix, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 as rows of 64-bit words."""
    packed = np.packbits(bits.astype(np.uint8), axis=1)
    wide = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and correction scalars of unit vectors."""
    turned = unit @ turn.T
    bits = turned > 0
    scalar = np.where(bits, turned, -turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return _pack(bits), scalar


def estimate(codes: np.ndarray, scalars: np.ndarray, query: np.ndarray, turn: np.ndarray, errors: float = ERRORS) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of a unit query with coded unit vectors, and their bounds."""
    d = len(query)
    q = turn @ query
    low, high = q.min(), q.max()
    step = (high - low) / ((1 << PLANES) - 1) or 1.0
    levels = np.rint((q - low) / step).astype(np.int64)
    total = np.zeros(len(codes), np.int64)
    for k in range(PLANES):
        plane = _pack((levels >> k & 1)[None, :])
        total += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << k
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    # <o', q> with o' = (2 bit - 1) / sqrt(d) and q = low + step * level.
    dot = (2 * (step * total + low * ones) - (step * levels.sum() + low * d)) / np.sqrt(d)
    scalars = np.maximum(scalars, 1e-9)
    spread = np.sqrt(np.maximum(0.0, 1 - scalars**2) / (scalars**2 * max(d - 1, 1)))
    return dot / scalars, errors * spread + step / (2 * scalars)


def valid(vector: Column) -> Column:
    """Neither null nor zero nor holding a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


_BLOCK_SCHEMA = "dim int, block long, ids binary, vectors binary, codes binary, scalars binary"


def blocks(rows: DataFrame, size: int, coded: bool) -> DataFrame:
    """vec_id, vector -> one row for up to ``size`` vectors of one dimension.

    Vectors stay where they were read; the last block of a dimension in a task is
    smaller. ``block`` differs from block to block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}
        made = TaskContext.get().partitionId() << 32

        def out(d: int) -> pa.RecordBatch:
            nonlocal made
            ids, x = (np.concatenate(p) for p in zip(*held.pop(d)))
            count[d] = 0
            if coded:
                ids, x = _once(ids, x)
            made += 1
            codes, scalars = b"", b""
            if coded:
                c, s = encode(_unit(x), rotation(d))
                codes, scalars = c.tobytes(), s.tobytes()
            values = ([d], [made], [ids.tobytes()], [x.tobytes()], [codes], [scalars])
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["dim", "block", "ids", "vectors", "codes", "scalars"])

        for batch in batches:
            dims = np.diff(batch["vector"].offsets.to_numpy())
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                ids = part["vec_id"].to_numpy(zero_copy_only=False).astype(np.int64)
                x = part["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), d)
                for i in range(0, len(ids), size):
                    held.setdefault(d, []).append((ids[i : i + size], x[i : i + size]))
                    count[d] = count.get(d, 0) + len(ids[i : i + size])
                    if count[d] >= size:
                        yield out(d)
        for d in list(held):
            yield out(d)

    return rows.select("vec_id", "vector").mapInArrow(run, _BLOCK_SCHEMA)


def _once(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows wholly alike are one, so that a block's k best are k candidates."""
    x = x + 0.0  # -0.0 is 0.0
    if len(np.unique(ids)) == len(ids):
        return ids, x
    first: dict[tuple[int, bytes], int] = {}
    for i, d in enumerate(ids.tolist()):
        first.setdefault((d, x[i].tobytes()), i)
    at = np.fromiter(first.values(), np.int64, len(first))
    return ids[at], x[at]


def _unit(x: np.ndarray) -> np.ndarray:
    # By the largest component first, so that no square overflows or vanishes.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one vector with rows, each row summed by itself: equal rows score equally."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        dot = (x * query).sum(axis=1)
        norm = np.sqrt((x * x).sum(axis=1)) * np.sqrt((query * query).sum())
        out = dot / norm
    # Squares beyond the range of doubles: by unit vectors instead.
    odd = ~(np.isfinite(dot) & np.isfinite(norm) & (norm > 1e-290))
    if odd.any():
        out[odd] = (_unit(x[odd]) * _unit(query[None, :])).sum(axis=1)
    return out


def nearest_in_block(query_id: int, query: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, scalars: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Ids and cosines of the k nearest in a block, how many were measured, and the places of the nearest."""
    near, bound = estimate(codes, scalars, _unit(query[None, :])[0], turn)
    mine = np.flatnonzero(ids != query_id)
    scores = np.full(len(ids), -np.inf)
    first = mine
    if len(mine) > FIRST * k:
        first = mine[np.argpartition(-near[mine], FIRST * k)[: FIRST * k]]
    scores[first] = cosine(query, x[first])
    measured = len(first)
    if len(mine) > measured:
        reach = np.partition(scores[first], len(first) - k)[len(first) - k]
        rest = mine[((near + bound)[mine] >= reach) & np.isneginf(scores[mine])]
        scores[rest] = cosine(query, x[rest])
        measured += len(rest)
    seen = mine[~np.isneginf(scores[mine])]
    best = seen[np.lexsort((ids[seen], -scores[seen]))[:k]]
    return ids[best], scores[best], measured, best


def search(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every query row, by cosine.

    Queries are the rows of ``rows`` for which ``is_query`` holds, candidates all rows
    but those with the query's id. Nearest first, ties to the smaller id. Rows without
    an id and vectors that are null, zero, or hold null or non-finite components take
    no part; vectors are compared with those of their dimension. Rows that share an id
    and differ are candidates of their own, rows wholly alike one. A query without
    candidates has no row; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("is_query"))
    rows = rows.filter(F.col("vec_id").isNotNull() & valid(F.col("vector")))
    coded = persist_table(blocks(rows, BLOCK, True), "codes")
    asked = rows.filter("is_query")
    # Few tasks, so that blocks of queries are full: each meets all vectors once.
    asked = asked.repartition(max(1, -(-asked.count() // QUERIES)))
    asked = persist_table(blocks(asked, QUERIES, False).select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "queries")

    # Each block of vectors meets each block of queries of its dimension; the vectors
    # are dealt to as many places as there are tasks, the queries go to each place. Spark
    # knows the size of the queries stored, not of their copies, which must not be broadcast.
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = coded.withColumn("place", F.pmod(F.xxhash64("block"), F.lit(places)))
    asked = asked.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(places - 1).cast("long"))))
    pairs = coded.join(asked.hint("merge"), ["dim", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                d = batch["dim"][row].as_py()
                raw = {c: batch[c][row].as_buffer() for c in ("ids", "vectors", "codes", "scalars", "q_ids", "q_vectors")}
                ids = np.frombuffer(raw["ids"], np.int64)
                x = np.frombuffer(raw["vectors"], np.float64).reshape(-1, d)
                codes = np.frombuffer(raw["codes"], np.uint64).reshape(len(ids), -1)
                scalars, turn = np.frombuffer(raw["scalars"], np.float64), rotation(d)
                q_ids = np.frombuffer(raw["q_ids"], np.int64)
                found = [(q, *nearest_in_block(q, v, ids, x, codes, scalars, turn, k)) for q, v in zip(q_ids.tolist(), np.frombuffer(raw["q_vectors"], np.float64).reshape(-1, d))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(q_ids, [len(f[1]) for f in found])),
                        pa.array(np.concatenate([f[1] for f in found])),
                        pa.array(np.concatenate([f[2] for f in found])),
                        pa.array([blake2b(x[i].tobytes(), digest_size=16).digest() for f in found for i in f[4].tolist()], pa.binary()),
                    ],
                    ["query_id", "vec_id", "score", "digest"],
                )

    # Rows wholly alike from several blocks; others may share an id and score.
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double, digest binary").distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(spark, sf_dir):
    from .common import table

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
