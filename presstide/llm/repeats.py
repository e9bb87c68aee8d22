"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a row
of smaller doc_id, or at a smaller start of the same id. The start of such a string has
a longest previous factor of LENGTH or more.

1. Sampling decides which suffixes can meet. Every window of LENGTH bytes has an anchor,
   its least ``GRAM``-byte string by hash (the first of equals), so equal windows have
   equal anchors at equal offsets. Windows next to one another mostly share one: a run.
   The rows are runs: the anchor's hash (key), a hash of all text the run covers (ctx),
   and the place. Runs whose whole text is there earlier within a slice stay behind as
   spans.
2. Sorted by (key, ctx, place) over range partitions, the first run of each ctx is kept,
   the later ones are repeats. Where a key has several ctx, their first runs are
   candidates: parts of them may be equal.
3. Candidates fetch their text. Key by key, and many keys at once, their windows are
   suffix-sorted, cut off after LENGTH bytes; previous and next smaller places in that
   order give each one's longest previous factor.
4. A key with more than ``BLOCK`` candidates is dealt out in parts, each like a key. What
   its parts leave open is decided by one more round: those windows, by the 128 bits of
   two hashes that cover them, are grouped for their least place, with partial sums.
5. Spans meet their texts by (id, hash of the text).

Keys and places are all that is shuffled for text without repeats; a passage that is
everywhere sends one run a slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_and_text, mix64, persist_table, slices

LENGTH, GRAM = 100, 32
#: Anchors that a window chooses from.
CHOICE = LENGTH - GRAM + 1
#: Bytes of candidate texts that a task sorts at once, or one key's if it has more.
CHUNK = 1 << 21
#: Candidates of a key that one task sorts.
BLOCK = 4096

_rng = np.random.default_rng(11)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 32 and of the 64 bytes from each position (past the end: of zeros)."""
    h = _BYTE[np.concatenate([data, np.zeros(64, np.uint8)])]
    out, size = [], 1
    with np.errstate(over="ignore"):
        for level in range(6):
            h = mix64(h[: len(h) - size] * _MUL[level] + h[size:])
            size *= 2
            if size in (32, 64):
                out.append(h[: len(data)])
    return out[0], out[1]


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """key, ctx, lo, n of each run of windows, in order; ``ends``: where the texts end."""
    none = np.zeros(0, np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    n_windows = np.maximum(ends - begins - LENGTH + 1, 0)
    total = int(n_windows.sum())
    if not total:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    gram, wide = gram_hashes(data)
    place = np.arange(len(data), dtype=np.uint64)
    # The high half orders, the low half tells the place and so prefers the first of equals.
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | place
    size = 1
    while 2 * size <= CHOICE:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (CHOICE - size)], low[CHOICE - size :])
    starts = np.repeat(begins - np.cumsum(n_windows) + n_windows, n_windows) + np.arange(total)
    anchor = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    lo, a, n = starts[first], anchor[first], np.diff(np.append(first, total))
    # The covered text is LENGTH + n - 1 bytes, three strings of 64 at most.
    last = lo + LENGTH + n - 1 - 64
    with np.errstate(over="ignore"):
        shape = (n * 256 + (a - lo)).astype(np.uint64)
        ctx = mix64(wide[lo] * _MUL[6] + mix64(wide[(lo + last) // 2] * _MUL[7] + mix64(wide[last] + shape)))
    return gram[a], ctx, lo, n


def _joined(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans, ascending by their starts, as maximal runs."""
    if not len(lo):
        return lo, hi
    top = np.maximum.accumulate(hi)
    new = np.concatenate([[True], lo[1:] > top[:-1]])
    first = np.flatnonzero(new)
    return lo[first], top[np.append(first[1:] - 1, len(lo) - 1)]


def _arrow_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each ends."""
    wide = texts.cast(pa.large_binary())
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    body = wide.buffers()[2]
    data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, ends[1:] - ends[0]


_RUN = "key long, ctx long, doc_id long, tag long, lo long, n long"
_RUN_ARROW = pa.schema([(f.split()[0], pa.int64()) for f in _RUN.split(", ")])


def run_rows(docs: DataFrame) -> DataFrame:
    """The runs of every text: key, ctx, doc_id, tag, lo, n; spans already known have no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, ends = _arrow_bytes(part["text"])
                tags = part["tag"].to_numpy()
                key, ctx, lo, n = runs(data, ends)
                if not len(lo):
                    continue
                begins = np.concatenate([[0], ends[:-1]])
                row = np.searchsorted(ends, lo, side="right")
                null, ids = np.asarray(part["doc_id"].is_null()), part["doc_id"].fill_null(0).to_numpy()
                lo = lo - begins[row]
                # By text, then by place: ids in order, null last.
                order = np.lexsort((lo, ids[row], null[row], ctx, key))
                k, c, i, z, at = key[order], ctx[order], ids[row][order], null[row][order], lo[order]
                new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
                first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
                later = (i != i[first]) | (z != z[first]) | (at != at[first])
                gone = np.zeros(len(lo), bool)
                gone[order[later]] = True
                stay = np.flatnonzero(~gone)
                spans = np.flatnonzero(gone)
                # Spans of one text that touch become one; texts are set apart for that.
                apart = begins[row[spans]] + row[spans]
                s_lo, s_hi = _joined(lo[spans] + apart, lo[spans] + n[spans] + LENGTH - 1 + apart)
                s_row = np.searchsorted(begins + np.arange(len(begins)), s_lo, side="right") - 1
                s_lo, s_hi = s_lo - begins[s_row] - s_row, s_hi - begins[s_row] - s_row
                at_row = np.concatenate([row[stay], s_row])
                known = np.concatenate([np.zeros(len(stay), bool), np.ones(len(s_row), bool)])
                columns = {
                    "key": pa.array(np.concatenate([key[stay], np.zeros(len(s_row), np.uint64)]).view(np.int64), mask=known),
                    "ctx": pa.array(np.concatenate([ctx[stay], np.zeros(len(s_row), np.uint64)]).view(np.int64), mask=known),
                    "doc_id": pa.array(ids[at_row], pa.int64(), mask=null[at_row]),
                    "tag": pa.array(tags[at_row]),
                    "lo": pa.array(np.concatenate([lo[stay], s_lo])),
                    "n": pa.array(np.concatenate([n[stay], s_hi - s_lo - LENGTH + 1])),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, _RUN)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before; the first does."""
    return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]) if len(columns[0]) else np.zeros(0, bool)


def _sorted_out(rows: DataFrame) -> DataFrame:
    """Of runs sorted by (key, ctx, place) within ranges: the later runs of a ctx, as spans
    without a key, and the candidates: the first runs of keys with several ctx. A range's
    first and last key may go on in other ranges, so their first runs all stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, first_key = None, None  # the run that leads the current ctx; the range's first key
        held, at_key, several = None, None, False  # first runs of the current key while it has one ctx

        for batch in batches:
            if not batch.num_rows:
                continue
            key, ctx = batch["key"].to_numpy(), batch["ctx"].to_numpy()
            null = np.asarray(batch["doc_id"].is_null())
            ids, lo = batch["doc_id"].fill_null(0).to_numpy(), batch["lo"].to_numpy()
            if lead is None:
                lead, first_key = (key[0], ctx[0], ids[0], null[0], lo[0]), key[0]
            new = _changes(key, ctx)
            new[0] = lead[:2] != (key[0], ctx[0])
            by = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            led = [np.where(by >= 0, c[by], x) for c, x in zip((ids, null, lo), lead[2:])]
            later = (ids != led[0]) | (null != led[1]) | (lo != led[2])
            if by[-1] >= 0:
                lead = tuple(c[by[-1]] for c in (key, ctx, ids, null, lo))
            table = pa.Table.from_arrays(batch.columns, schema=_RUN_ARROW)
            spans = table.filter(pa.array(later))
            nulls = pa.nulls(spans.num_rows, pa.int64())
            out = [pa.Table.from_arrays([nulls, nulls, *spans.columns[2:]], schema=_RUN_ARROW)]
            firsts = table.filter(pa.array(~later))
            if firsts.num_rows:
                firsts = firsts if held is None else pa.concat_tables([held, firsts])
                key, ctx = firsts["key"].to_numpy(), firsts["ctx"].to_numpy()
                starts = np.flatnonzero(_changes(key))
                many = np.minimum.reduceat(ctx, starts) != np.maximum.reduceat(ctx, starts)
                many |= (key[starts] == first_key) | ((key[starts] == at_key) & several)
                keep = np.repeat(many, np.diff(np.append(starts, len(key))))
                at_key, several = key[-1], bool(many[-1])
                held = None if several else firsts.slice(int(starts[-1]))
                out.append(firsts.filter(pa.array(keep)))
            for found in out:
                yield from found.combine_chunks().to_batches()
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return rows.mapInArrow(run, _RUN)


def _texts_of(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Each candidate run with the text it covers."""
    wanted = candidates.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("key", "part", "lo", "n")).alias("runs"))
    wanted = persist_table(wanted.withColumnsRenamed({"doc_id": "w_id", "tag": "w_tag"}), "wanted-runs")
    rows = docs.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("tag") == F.col("w_tag"))).select("doc_id", "tag", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, ends = _arrow_bytes(part["text"])
                found = part["runs"]
                each = np.diff(found.offsets.to_numpy())
                flat = found.flatten()
                row = np.repeat(np.arange(part.num_rows), each)
                begin = np.concatenate([[0], ends[:-1]])[row] + flat.field("lo").to_numpy()
                end = begin + flat.field("n").to_numpy() + LENGTH - 1
                body = data.tobytes()
                texts = pa.array([body[a:b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary())
                row = pa.array(row)
                yield pa.RecordBatch.from_pydict({"key": flat.field("key"), "part": flat.field("part"), "doc_id": part["doc_id"].take(row), "tag": part["tag"].take(row), "lo": flat.field("lo"), "text": texts})

    return rows.mapInArrow(run, "key long, part int, doc_id long, tag long, lo long, text binary")


def suffix_ranks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes at ``starts`` in the order of their first LENGTH bytes, by prefix doubling."""
    padded = np.concatenate([data, np.zeros(LENGTH + 8, np.uint8)])
    words = np.zeros(len(data) + LENGTH, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(words)]
    rank = np.unique(words, return_inverse=True)[1].astype(np.uint64)
    size = 8
    while 2 * size <= LENGTH:
        rank = np.unique((rank[:-size] << np.uint64(32)) | rank[size:], return_inverse=True)[1].astype(np.uint64)
        size *= 2
    return np.unique((rank[starts] << np.uint64(32)) | rank[starts + LENGTH - size], return_inverse=True)[1]


def smaller_before(place: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of each entry the nearest one before it in its group with a smaller place, or -1.

    Pointers jump over what is no smaller, all at once, until none moves.
    """
    to = np.arange(len(place)) - 1
    while True:
        i = np.flatnonzero(to >= 0)
        i = i[(group[to[i]] == group[i]) & (place[to[i]] >= place[i])]
        if not len(i):
            return np.where((to >= 0) & (group[np.maximum(to, 0)] == group), to, -1)
        to[i] = to[to[i]]


def has_previous_factor(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each suffix has one of equal rank (so LENGTH bytes in common) and smaller place.

    In suffix order it is the previous or the next smaller place that a suffix shares most
    with, so these two decide.
    """
    order = np.argsort(rank, kind="stable")
    group = rank[order]
    alone = _changes(group) & np.append(_changes(group)[1:], True)
    order, group = order[~alone], group[~alone]
    at = place[order]
    previous = smaller_before(at, group)
    following = smaller_before(at[::-1], group[::-1])[::-1]
    out = np.zeros(len(rank), bool)
    out[order] = (previous >= 0) | (following >= 0)
    return out


_FOUND = "doc_id long, tag long, lo long, n long, h1 long, h2 long"


def _in_parts(candidates: DataFrame, block: int) -> DataFrame:
    """``candidates`` with part: -1, or of a key with more than ``block`` of them one of several numbers."""
    many = candidates.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > block)
    many = persist_table(many.select("key", F.ceil(F.col("m") / block).alias("parts")), "hot-keys")
    part = F.pmod(F.xxhash64("doc_id", "tag", "lo"), F.col("parts"))
    return candidates.join(many, "key", "left").withColumn("part", F.coalesce(part, F.lit(-1)).cast("int")).drop("parts")


def _factored(candidates: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Spans among candidates that lie together by (key, part), and with h1 and h2 the
    windows left of keys in parts, which other parts may have too."""

    def work(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        data, ends = _arrow_bytes(batch["text"])
        begins = np.concatenate([[0], ends[:-1]])
        n = ends - begins - LENGTH + 1
        total = int(n.sum())
        row = np.repeat(np.arange(len(n)), n)
        offset = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        starts = begins[row] + offset
        null = np.asarray(batch["doc_id"].is_null())[row]
        ids, at = batch["doc_id"].fill_null(0).to_numpy()[row], batch["lo"].to_numpy()[row] + offset
        # Windows of different keys have different anchors, so equal ranks have equal keys.
        order = np.lexsort((at, ids, null))
        place = np.empty(total, np.int64)
        place[order] = np.cumsum(_changes(at[order], ids[order], null[order]))
        part = batch["part"].to_numpy()[row]
        # Parts of one key are told apart by their numbers, which come before the ranks.
        _, group = np.unique(suffix_ranks(data, starts) * (part.max() + 2) + part, return_inverse=True)
        gone = has_previous_factor(group, place)
        cut = (part >= 0) & ~gone
        first = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1] & (row[1:] == row[:-1])]))
        last = np.flatnonzero(gone & ~np.append(gone[1:] & (row[1:] == row[:-1]), False))
        left = np.flatnonzero(cut)
        wide = gram_hashes(data)[1].view(np.int64) if len(left) else np.zeros(0, np.int64)
        pick = pa.array(np.concatenate([row[first], row[left]]))
        none = pa.nulls(len(first), pa.int64())
        out = pa.RecordBatch.from_pydict(
            {
                "doc_id": batch["doc_id"].take(pick),
                "tag": batch["tag"].take(pick),
                "lo": pa.array(np.concatenate([at[first], at[left]])),
                "n": pa.array(np.concatenate([last - first + 1, np.ones(len(left), np.int64)])),
                "h1": pa.concat_arrays([none, pa.array(wide[starts[left]] if len(left) else wide, pa.int64())]),
                "h2": pa.concat_arrays([none, pa.array(wide[starts[left] + LENGTH - 64] if len(left) else wide, pa.int64())]),
            }
        )
        yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for rows in slices(batch, "text", chunk):
                held.append(rows)
                size += rows["text"].nbytes
                if size < chunk:
                    continue
                # The last key's part may go on.
                table = pa.Table.from_batches(held).combine_chunks()
                new = np.flatnonzero(_changes(table["key"].to_numpy(), table["part"].to_numpy()))
                cut = int(new[-1])
                if cut:
                    yield from work(table.slice(0, cut).to_batches())
                held = table.slice(cut).to_batches()
                size = sum(x["text"].nbytes for x in held) if cut else 0
        if held:
            yield from work(held)

    return candidates.mapInArrow(run, _FOUND)


def _settled(left: DataFrame) -> DataFrame:
    """Of windows (h1, h2, place), those that are not the first of their kind."""
    place = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0).cast("long")), F.col("lo"))
    least = left.groupBy("h1", "h2").agg(F.min(place).alias("least"), F.max(place).alias("most")).filter("least <> most")
    least = persist_table(least.select("h1", "h2", "least"), "first-windows")
    return left.join(least, ["h1", "h2"]).filter(place > F.col("least"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """doc_id, tag (xxhash64 of the text), spans: array of (lo, hi) in bytes, of every text with repeats.

    Spans may touch and overlap; together they cover the bytes that go. A null text is
    empty. Rows without an id come after all others and count as rows of one id. Rows
    that share an id are one document to the order: what starts at the same byte in two
    of them is not earlier in either. An empty table has no spans.
    """
    texts = _texts(docs, id_col, text_col)
    found = persist_table(run_rows(texts), "runs")
    ranged = found.filter("key is not null").repartitionByRange("key", "ctx", F.col("doc_id").asc_nulls_last(), "lo")
    sorted_runs = ranged.sortWithinPartitions("key", "ctx", F.col("doc_id").asc_nulls_last(), "lo")
    known = persist_table(_sorted_out(sorted_runs), "sorted-runs")
    covered = persist_table(_texts_of(_in_parts(known.filter("key is not null"), block), texts), "run-texts")
    dealt = covered.repartitionByRange("key", "part").sortWithinPartitions("key", "part")
    factored = persist_table(_factored(dealt, chunk), "factored")
    spans = found.filter("key is null").select("doc_id", "tag", "lo", "n")
    spans = spans.unionByName(known.filter("key is null").select("doc_id", "tag", "lo", "n"))
    spans = spans.unionByName(factored.filter("h1 is null").select("doc_id", "tag", "lo", "n"))
    spans = spans.unionByName(_settled(factored.filter("h1 is not null")).select("doc_id", "tag", "lo", "n"))
    span = F.struct("lo", (F.col("lo") + F.col("n") + (LENGTH - 1)).alias("hi"))
    return persist_table(spans.groupBy("doc_id", "tag").agg(F.collect_list(span).alias("spans")), "spans")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).withColumn("tag", F.xxhash64("text"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, block: int = BLOCK, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, what is left of the text in bytes, of every row.

    ``digest``: instead of kept its sha256, kept_sha256. Other columns of ``docs`` are not
    looked at. A cut may fall inside a character, so kept is binary.
    """
    spans = repeated_spans(docs, id_col, text_col, chunk, block).withColumnsRenamed({"doc_id": "s_id", "tag": "s_tag"})
    texts = _texts(docs, id_col, text_col)
    rows = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("tag") == F.col("s_tag")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
                for text, found in zip(part["text"], part["spans"]):
                    body = bytes(text.as_buffer())
                    kept, n_spans, size = body, 0, len(body)
                    if found.is_valid:
                        lo, hi = (found.values.field(c).to_numpy() for c in ("lo", "hi"))
                        order = np.argsort(lo, kind="stable")
                        lo, hi = _joined(lo[order], hi[order])
                        n_spans = len(lo)
                        cuts = zip([0, *hi.tolist()], [*lo.tolist(), size])
                        kept = b"".join(body[a:b] for a, b in cuts)
                    out["n_bytes"].append(size)
                    out["n_removed"].append(size - len(kept))
                    out["n_spans"].append(n_spans)
                    out["kept"].append(hashlib.sha256(kept).hexdigest() if digest else kept)
                counts = {k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")}
                kept = {"kept_sha256": pa.array(out["kept"], pa.string())} if digest else {"kept": pa.array(out["kept"], pa.binary())}
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], **counts, **kept})

    return rows.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if digest else 'kept binary'}")


def op11(spark, sf_dir):
    from .common import table

    return without_repeats(table(spark, sf_dir, "documents"), digest=True)
