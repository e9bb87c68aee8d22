"""Near-duplicates by b-bit MinHash: candidates by bands, links on full shingle sets.

1. Each text becomes its set of word shingles (64-bit hashes), and the set its size,
   its digest and ``HASHES`` minima. Of a minimum only ``BITS`` low bits are kept,
   packed into a signature; before that, every ``ROWS`` minima give one band key.
2. Texts with equal sets are one class (equal digests), whose least id stands for it.
3. Within a band bucket, classes whose signatures look alike are candidates: their
   similarity, corrected for chance agreement of the kept bits, is not more than 4.5
   standard errors below the threshold. A bucket gives links that join its candidates,
   fewer than it has members. Components of these links are clusters.
4. Each text moves to its cluster, where every pair that looks alike is held against
   the full sets, save pairs joined already. Components of the confirmed links, again
   fewer than members, are the result: pairs that are refuted are never rows.

With 48 bands of 5 rows, a pair at similarity 0.75 shares no band once in 400,000.
A bucket or cluster of any size is worked on in blocks, each two of which meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import hash_words, id_and_text, mix64, persist_table, slices, split_words, unused
from .components import components

SHINGLE = 5
BANDS, ROWS, BITS = 48, 5, 4
#: Minima of a signature; the first BANDS * ROWS of them make the band keys too.
HASHES = 2 * BANDS * ROWS
PERCENT = 75
#: Classes and shingles of a block; two blocks meet in one task.
BLOCK, BLOCK_SHINGLES = 8192, 1 << 22
#: Bits that tell whether a value is in a set; of a larger set they only tell less.
SET_BITS = 1 << 26

_rng = np.random.default_rng(20)
_MUL = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_BAND = _rng.integers(1, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64) | np.uint64(1)
_TERM = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_LENGTH = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A text
    of fewer than five words is one shingle; a null text or one without words, none.
    """
    words, ends = split_words(pc.ascii_lower(texts))
    h = hash_words(words)
    out = []
    with np.errstate(over="ignore"):
        n = len(h) - SHINGLE + 1
        runs = mix64(sum(h[k : n + k] * _TERM[k] for k in range(SHINGLE))) if n > 0 else np.zeros(0, np.uint64)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a >= SHINGLE:
                out.append(np.unique(runs[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(mix64((h[a:b] * _TERM[: b - a]).sum(keepdims=True, dtype=np.uint64) + _LENGTH * np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def minima(sets: list[np.ndarray], most: int = 1 << 15) -> np.ndarray:
    """HASHES minima of each set; sets are worked on in runs that stay in the processor's cache."""
    out = np.empty((len(sets), HASHES), np.uint32)
    i = 0
    while i < len(sets):
        j, held = i, 0
        while j < len(sets) and (j == i or held + len(sets[j]) <= most):
            held += len(sets[j])
            j += 1
        low = (np.concatenate(sets[i:j]) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0] + [len(s) for s in sets[i : j - 1]])
        work = np.empty_like(low)
        for k in range(HASHES):
            np.multiply(low, _MUL[k], out=work)
            np.add(work, _ADD[k], out=work)
            out[i:j, k] = np.minimum.reduceat(work, at)
        i = j
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = mins[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
        return mix64((rows * _BAND[:, :ROWS]).sum(axis=2, dtype=np.uint64) + _BAND[:, ROWS]).view(np.int64)


def signatures(mins: np.ndarray) -> np.ndarray:
    """The low BITS of each (scattered) minimum, two in a byte."""
    with np.errstate(over="ignore"):
        x = mins ^ (mins >> np.uint32(15))
        low = ((x * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


_LOW = np.uint64(0x1111111111111111)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of signatures given as rows of 64-bit words (broadcast)."""
    x = a ^ b
    x = (x | (x >> np.uint64(1)) | (x >> np.uint64(2)) | (x >> np.uint64(3))) & _LOW
    same = 1.0 - np.bitwise_count(x).sum(axis=-1, dtype=np.int64) / HASHES
    return (same - 2.0**-BITS) / (1.0 - 2.0**-BITS)


def least_similarity(percent: int = PERCENT, errors: float = 4.5) -> float:
    """Estimates below this are discarded: ``errors`` standard errors under the threshold."""
    p = percent / 100 * (1 - 2.0**-BITS) + 2.0**-BITS
    return percent / 100 - errors * (p * (1 - p) / HASHES) ** 0.5 / (1 - 2.0**-BITS)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, digest, signature, bands (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part["text"])
                digests = [digest(s) if len(s) else None for s in sets]
                # Equal sets within a slice are worked out once.
                first: dict[bytes, int] = {}
                for i, d in enumerate(digests):
                    if d is not None:
                        first.setdefault(d, i)
                mins = minima([sets[i] for i in first.values()])
                place = dict(zip(first, range(len(first))))
                rows = [place.get(d) for d in digests]
                packed, keys = signatures(mins), band_keys(mins)
                full = np.array([r for r in rows if r is not None], np.int64)
                offsets = np.concatenate([[0], np.cumsum([0 if r is None else BANDS for r in rows])]).astype(np.int32)
                none = pa.array([r is None for r in rows])
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].reshape(-1)), mask=none)
                sig = pa.array([None if r is None else packed[r].tobytes() for r in rows], pa.binary())
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part["doc_id"], n, pa.array(digests, pa.binary()), sig, bands], ["doc_id", "n_shingles", "digest", "signature", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary, bands array<long>")


def _alike(sets: list[np.ndarray], percent: int):
    """A function (i, others) -> whether 100 * common >= percent * all, of sorted distinct sets.

    Many others are counted in one pass over all sets, few by a search each.
    """
    size = np.array([len(s) for s in sets], np.int64)
    begins = np.cumsum(size) - size
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(known), np.int64)

    def same(i: int, others: np.ndarray) -> np.ndarray:
        others = others[100 * np.minimum(size[i], size[others]) >= percent * np.maximum(size[i], size[others])]
        own = ids[begins[i] : begins[i] + size[i]]
        mark[own] = 1
        if len(others) * 4096 > len(ids):
            both = np.add.reduceat(mark[ids], begins)[others]
        else:
            both = np.array([mark[ids[begins[j] : begins[j] + size[j]]].sum() for j in others], np.int64)
        mark[own] = 0
        return others[100 * both >= percent * (size[i] + size[others] - both)]

    return same


def _forest(sigs: np.ndarray, left: np.ndarray, right: np.ndarray, least: float, same=None) -> list[tuple[int, int]]:
    """Links that join all that look alike (and are, by ``same``), fewer than there are members.

    ``left`` and ``right`` are the places of two blocks, equal for one block by itself.
    A member is only held against those that no link has joined to it so far.
    """
    label = np.arange(len(sigs))
    out = []
    alone = left is right
    for i in left:
        near = right[label[right] != label[i]]
        if alone:
            near = near[near > i]
        near = near[similarity(sigs[i][None, :], sigs[near]) >= least]
        if same is not None and len(near):
            near = same(i, near)
        for j in near:
            if label[j] != label[i]:
                out.append((int(i), int(j)))
                label[label == label[j]] = label[i]
    return out


def _set_bits(values: DataFrame, column: str) -> DataFrame:
    """A set of long numbers as bits at a hash of each: rows of 4 KB, SET_BITS / 8 bytes
    in all at most, so they are broadcast whatever the set's size."""
    bit = F.pmod(F.xxhash64(column), F.lit(SET_BITS).cast("long"))
    rows = values.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bit_row"))
    return persist_table(rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")), "set-bits")


def _marked(rows: DataFrame, column: str, bits: DataFrame, mark: str) -> DataFrame:
    """``rows`` with the column ``mark``: true for every member of the set, and for a few others."""
    bit = F.pmod(F.xxhash64(column), F.lit(SET_BITS).cast("long"))
    place = F.bitmap_bit_position(bit)
    out = rows.join(F.broadcast(bits), F.bitmap_bucket_number(bit) == F.col("bit_row"), "left")
    byte = F.conv(F.hex(F.substr("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1
    return out.withColumn(mark, F.coalesce(there, F.lit(False))).drop("bit_row", "bits")


def _dealt(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """``rows`` with own, x, y: a group of several blocks is cut by a hash, and each two
    of its blocks (and each by itself) meet under one (group, x, y)."""
    own = F.pmod(F.xxhash64("digest"), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    rows = rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other")
    return rows.repartition(group, "x", "y").sortWithinPartitions(group, "x", "y")


def _runs(batches: Iterator[pa.RecordBatch], group: str, prepare) -> Iterator[dict]:
    """The rows of each (group, x, y), in order, as columns; ``prepare`` gives a batch's columns as dict of lists."""
    at, held = None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = prepare(batch)
        where = np.stack([np.asarray(columns[c], np.int64) for c in (group, "x", "y")], axis=1)
        cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), len(where)]
        for a, b in zip(cuts, cuts[1:]):
            here = tuple(where[a].tolist())
            if here != at:
                if held:
                    yield held
                at, held = here, {c: [] for c in columns}
            for c, values in columns.items():
                held[c].extend(values[a:b])
    if held:
        yield held


def _sides(run: dict) -> tuple[np.ndarray, np.ndarray]:
    own = np.array(run["own"])
    left = np.flatnonzero(own == run["x"][0])
    return left, left if run["x"][0] == run["y"][0] else np.flatnonzero(own == run["y"][0])


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _candidates(members: DataFrame, least: float, blocks: int) -> DataFrame:
    """Links (a, b) that join all classes of a bucket whose signatures look alike, a forest a bucket.

    ``members``: key, digest, node, signature, large. Buckets marked large are cut into
    ``blocks`` parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for bucket in _runs(batches, "key", lambda batch: {c: batch[c].to_pylist() for c in ("key", "x", "y", "own", "node", "signature")}):
            node = bucket["node"]
            sigs = np.frombuffer(b"".join(bucket["signature"]), np.uint64).reshape(len(node), -1)
            found.extend((node[i], node[j]) for i, j in _forest(sigs, *_sides(bucket), least))
            if len(found) > 1 << 14:
                yield _links(found)
                found = []
        if found:
            yield _links(found)

    rows = _dealt(members, "key", F.when(F.col("large"), F.lit(blocks)).otherwise(F.lit(1)))
    return rows.select("key", "x", "y", "own", "node", "signature").mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def _confirmed(clusters: DataFrame, docs: DataFrame, nodes: DataFrame, least: float, percent: int) -> DataFrame:
    """Links (a, b) that join all classes of a cluster whose full sets are as similar as asked.

    ``clusters``: node, cluster. Candidates of one another share a cluster, so each text
    moves to its cluster's task alone; one of more than ``BLOCK`` classes or
    ``BLOCK_SHINGLES`` shingles is cut into blocks, each two of which meet in one task.
    Every pair that looks alike is held against the full sets there, save those that
    confirmed links have joined already.
    """
    wanted = nodes.join(clusters, "node").select("cluster", "node", F.col("digest").alias("want"), "n_shingles", "signature")
    wanted = persist_table(wanted, "wanted")
    size = F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)
    large = persist_table(wanted.groupBy("cluster").agg(F.ceil(size).alias("blocks")).filter("blocks > 1"), "large-clusters")
    # Texts that are not wanted stay where they are.
    there = _marked(docs.select("doc_id", "text"), "doc_id", _set_bits(wanted, "node"), "there").filter("there")
    rows = wanted.join(there.hint("merge"), F.col("node") == F.col("doc_id")).join(large, "cluster", "left")
    rows = rows.select("cluster", "node", "signature", "text", F.col("want").alias("digest"), F.coalesce("blocks", F.lit(1)).alias("blocks"))

    def columns(batch: pa.RecordBatch) -> dict:
        sets = [s for part in slices(batch, "text") for s in shingle_sets(part["text"])]
        # Rows that share an id have a set each, and only one is meant.
        meant = [i for i, (s, want) in enumerate(zip(sets, batch["digest"].to_pylist())) if digest(s) == want]
        batch = batch.take(pa.array(meant, pa.int64()))
        return {"sets": [sets[i] for i in meant]} | {c: batch[c].to_pylist() for c in ("cluster", "x", "y", "own", "node", "signature", "digest")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cluster in _runs(batches, "cluster", columns):
            # A row that is repeated changes nothing.
            once = sorted({d: i for i, d in enumerate(cluster["digest"])}.values())
            cluster = {c: [values[i] for i in once] for c, values in cluster.items()}
            node = cluster["node"]
            sigs = np.frombuffer(b"".join(cluster["signature"]), np.uint64).reshape(len(node), -1)
            found = [(node[i], node[j]) for i, j in _forest(sigs, *_sides(cluster), least, _alike(cluster["sets"], percent))]
            if found:
                yield _links(found)

    rows = _dealt(rows, "cluster", F.col("blocks")).select("cluster", "x", "y", "own", "node", "signature", "digest", "text")
    return rows.mapInArrow(run, "a long, b long").filter("a <> b")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Rows are linked where 100 * common shingles >= percent * all their shingles;
    component_id is the least id reachable. A text without words is linked with
    nothing and kept. A row without an id takes no part: its component_id is null and
    it is kept. Rows that share an id are one node: their links join, and all are kept
    or none. An empty table gives an empty result.
    """
    docs = id_and_text(docs, id_col, text_col)
    found = persist_table(features(docs), "minhash")
    linked = found.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    kept = ("n_shingles", "signature", "bands")
    nodes = persist_table(linked.groupBy("digest").agg(F.min("doc_id").alias("node"), *(F.any_value(c).alias(c) for c in kept)), "classes")
    least = least_similarity(percent)
    banded = nodes.select(F.explode("bands").alias("key"), "digest", "node", "signature")
    buckets = persist_table(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    shared, large = _set_bits(buckets, "key"), _set_bits(buckets.filter(F.col("n") > BLOCK), "key")
    blocks = max(1, -(-(buckets.agg(F.max("n")).first()[0] or 0) // BLOCK))
    members = _marked(_marked(banded, "key", shared, "shared").filter("shared"), "key", large, "large")
    candidates = persist_table(_candidates(members, least, blocks), "candidates")
    clusters = components(candidates).select("node", F.col("component").alias("cluster"))
    clusters = clusters.unionByName(clusters.select(F.col("cluster").alias("node"), "cluster").distinct())

    # Equal sets, and rows that share an id, join their classes.
    links = linked.groupBy("doc_id", "digest").agg(F.lit(1)).join(nodes.select("digest", "node"), "digest")
    links = links.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b")
    groups = components(links.unionByName(_confirmed(clusters, docs, nodes, least, percent)))

    joined = found.select("doc_id", "n_shingles").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all columns: that of the least id.

    Of rows that share an id the one whose text has the least hash stays. Rows without
    an id all stay.
    """
    found = persist_table(near_duplicates(docs, percent, id_col, text_col), "near-duplicates")
    kept_id, shared_id = unused(docs, "kept_id", "shared_id")
    kept = found.filter("kept").select(F.col("doc_id").alias(kept_id)).distinct()
    rows = docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)), "left_semi")
    shared = persist_table(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(shared_id)), "shared-ids")
    if shared.isEmpty():
        return rows
    same = F.col(id_col).cast("long") == F.col(shared_id)
    one = rows.join(shared, same, "left_semi").groupBy(F.col(id_col).alias("one_id")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(text_col)).alias("row"))
    return rows.join(shared, same, "left_anti").unionByName(one.select("row.*"))


def op9(spark, sf_dir):
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
