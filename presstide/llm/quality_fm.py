"""Quality classifier: a factorisation machine over words, structure and metadata.

A document is a sparse vector x: its hashed words (weights rising with the logarithm
of their counts, of length one together), its structure statistics and its metadata,
each statistic as the step of a scale it falls on. The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

which weighs all pairs of features in time linear in their number. The model is
fitted by AdaGrad on a bounded sample of labelled rows and applied where the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import hash_words, slices, split_words

WORDS = 1 << 16
FACTORS = 8
STEPS = 16
#: Labelled rows that a fit reads at most (those first by a hash of the id).
MAX_LABELLED = 12_000
THRESHOLD = 0.3

STATISTICS = (
    "words", "word_length", "chars_per_line", "lines", "upper", "digits", "symbols", "non_ascii", "marked_words",
    "upper_words", "bare_symbols", "repeats_last", "distinct", "capitalised", "sentence_ends", "commas", "stated_length",
)
SIZE = WORDS + len(STATISTICS) * STEPS


def _byte_class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars)] = 1
    return table


_UPPER = _byte_class(bytes(range(65, 91)))
_DIGIT = _byte_class(bytes(range(48, 58)))
_SYMBOL = _byte_class(b"#$%&*+/<=>@[\\]^_`{|}~!")
_HIGH = _byte_class(bytes(range(128, 256)))
_LINE, _END, _COMMA = _byte_class(b"\n"), _byte_class(b".!?"), _byte_class(b",;:")


def _per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``starts`` (one more than texts)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[starts[1:]] - total[starts[:-1]]).astype(np.float64)


def vectors(texts: pa.Array, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """offsets, features, weights of each text; ``stated`` is its metadata length (nan: none).

    Any text has one step of every scale; an empty or null one has no words.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    raw = np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_pylist()), np.uint8)
    count = lambda table: _per_text(table[raw], at)
    upper, digits, symbols, high, lines, ends, commas = map(count, (_UPPER, _DIGIT, _SYMBOL, _HIGH, _LINE, _END, _COMMA))

    words, w_at = split_words(texts.cast(pa.string()))
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    once = coded.dictionary
    flag = lambda p: pc.match_substring_regex(once, p).to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(once) else np.zeros(0, np.int64)
    marked = _per_text(flag(r"[[:alnum:]][#$%&*|~^!]{2,}"), w_at)
    caps = _per_text(flag(r"^[[:upper:]]{2,}[[:punct:]]*$"), w_at)
    bare = _per_text(flag(r"^[|*#~=_+-]+$"), w_at)
    title = _per_text(flag(r"^[[:upper:]]"), w_at)
    same = np.zeros(len(codes), np.int64)
    same[1:] = codes[1:] == codes[:-1]
    same[w_at[:-1][w_at[:-1] < len(codes)]] = 0
    repeats = _per_text(same, w_at)

    n_words = np.diff(w_at).astype(np.float64)
    text_of = np.repeat(np.arange(n), np.diff(w_at))
    hashed = (hash_words(once)[codes] % np.uint64(WORDS)).astype(np.int64) if len(once) else np.zeros(0, np.int64)
    keys, times = np.unique(text_of * WORDS + hashed, return_counts=True)
    doc, feature = keys // WORDS, keys % WORDS
    weight = np.log1p(times)
    norm = np.sqrt(np.bincount(doc, weight**2, n))
    weight = weight / norm[doc]

    per_word, per_char = 1 / np.maximum(n_words, 1), 1 / np.maximum(size, 1)
    chars = size - high / 2  # letters beyond ASCII take two bytes in the languages seen
    distinct = np.bincount(doc, minlength=n) * per_word
    stated = np.where(np.isnan(stated), -1.0, stated)
    shares = lambda x: np.sqrt(x) * (STEPS - 1)  # noqa: E731  fine steps near none
    scales = [
        np.log2(n_words + 1), size * per_word, 2 * np.log2(1 + chars / (lines + 1)) - 4, 2 * np.log2(1 + lines),
        shares(upper * per_char), shares(digits * per_char), shares(symbols * per_char), shares(high * per_char),
        shares(marked * per_word), shares(caps * per_word), shares(bare * per_word), shares(repeats * per_word),
        distinct * (STEPS - 1), shares(title * per_word), shares(np.minimum(1, ends * per_word)),
        shares(np.minimum(1, commas * per_word)), np.where(stated < 0, 0, 1 + np.log2(1 + np.maximum(stated, 0)) - 3),
    ]
    steps = np.clip(np.floor(np.stack(scales, axis=1)), 0, STEPS - 1).astype(np.int64)
    fixed = WORDS + np.arange(len(STATISTICS)) * STEPS + steps

    lens = np.bincount(doc, minlength=n) + len(STATISTICS)
    offsets = np.concatenate([[0], np.cumsum(lens)])
    place = offsets[doc] + np.arange(len(doc)) - np.concatenate([[0], np.cumsum(lens - len(STATISTICS))])[doc]
    features, weights = np.empty(offsets[-1], np.int32), np.empty(offsets[-1], np.float32)
    features[place], weights[place] = feature, weight
    tail = (offsets[1:] - len(STATISTICS))[:, None] + np.arange(len(STATISTICS))
    features[tail], weights[tail] = fixed, 0.5
    return offsets, features, weights


@dataclass
class Model:
    bias: float
    linear: np.ndarray  # SIZE
    factors: np.ndarray  # SIZE x FACTORS

    def score(self, offsets: np.ndarray, features: np.ndarray, weights: np.ndarray) -> np.ndarray:
        starts = offsets[:-1]
        v = self.factors[features] * weights[:, None]
        sums, squares = np.add.reduceat(v, starts), np.add.reduceat(v * v, starts)
        z = self.bias + np.add.reduceat(self.linear[features] * weights, starts) + 0.5 * (sums**2 - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def train(offsets: np.ndarray, features: np.ndarray, weights: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 256, rate: float = 0.2, decay: float = 2e-5, seed: int = 1) -> Model:
    """Fit by AdaGrad on logistic loss. No rows: every score is one half."""
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, FACTORS)).astype(np.float32))
    if not len(labels):
        model.factors[:] = 0
        return model
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    model.bias = float(np.log(share / (1 - share)))
    seen_b, seen_w, seen_v = 1e-6, np.full(SIZE, 1e-6, np.float32), np.full((SIZE, FACTORS), 1e-6, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            lens = offsets[rows + 1] - offsets[rows]
            starts = np.concatenate([[0], np.cumsum(lens)])
            take = np.repeat(offsets[rows] - starts[:-1], lens) + np.arange(starts[-1])
            f, x = features[take], weights[take]
            v = model.factors[f] * x[:, None]
            sums = np.add.reduceat(v, starts[:-1])
            p = model.score(starts, f, x)
            g = ((p - labels[rows]) / len(rows)).astype(np.float32)
            each, row = np.repeat(g, lens) * x, np.repeat(np.arange(len(rows)), lens)
            hit, to = np.unique(f, return_inverse=True)
            dw = np.bincount(to, each, len(hit)).astype(np.float32) + decay * model.linear[hit]
            dv = np.zeros((len(hit), FACTORS), np.float32)
            np.add.at(dv, to, each[:, None] * (sums[row] - v))
            dv += decay * model.factors[hit]
            seen_w[hit] += dw**2
            seen_v[hit] += dv**2
            seen_b += float(g.sum()) ** 2
            model.linear[hit] -= rate * dw / np.sqrt(seen_w[hit])
            model.factors[hit] -= 0.5 * rate * dv / np.sqrt(seen_v[hit])
            model.bias -= rate * float(g.sum()) / seen_b**0.5
    return model


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether a row is kept from every fit; a null id is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def _stated(batch: pa.RecordBatch, name: str | None) -> np.ndarray:
    if name is None:
        return np.full(batch.num_rows, np.nan)
    return pc.cast(batch[name], pa.float64()).to_numpy(zero_copy_only=False)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_LABELLED, length_col: str | None = "n_chars") -> Model:
    """A model from the labelled rows that are not held out, ``max_rows`` at most.

    ``labels``: doc_id and 0/1; null labels teach nothing, an id labelled more than
    once counts as 1 if at least half its labels are 1.
    """
    chosen = labels.filter(~held_out() & F.col(label_col).isNotNull()).groupBy("doc_id").agg((F.avg(label_col) >= 0.5).cast("int").alias("labelled_as"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).withColumnRenamed("doc_id", "labelled_id")
    # At most max_rows pairs of numbers.
    rows = docs.select("doc_id", "text", *([F.col(length_col).alias("stated")] if length_col else []))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).drop("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, features, weights = vectors(part["text"], _stated(part, "stated" if length_col else None))
                at = pa.array(offsets.astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (features, weights)]
                yield pa.RecordBatch.from_arrays([part["labelled_id"], part["labelled_as"], *lists], ["doc_id", "label", "features", "weights"])

    sample = rows.mapInArrow(run, "doc_id long, label int, features array<int>, weights array<float>").toArrow().combine_chunks()
    sample = sample.take(pc.sort_indices(sample, [("doc_id", "ascending"), ("label", "ascending")]))
    if not sample.num_rows:
        return train(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0))
    lens = pc.list_value_length(sample["features"]).to_numpy().astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lens)])
    flat = lambda c: pc.list_flatten(sample[c]).to_numpy()
    return train(offsets, flat("features"), flat("weights"), sample["label"].to_numpy().astype(np.float64))


def _scores(part: pa.RecordBatch, model: Model, text_col: str, length_col: str | None) -> np.ndarray:
    return model.score(*vectors(part[text_col], _stated(part, length_col)))


def score(docs: DataFrame, model: Model, length_col: str | None = "n_chars") -> DataFrame:
    """doc_id, score of every row: 0 to 1, higher where label 1 is likelier.

    Null and empty texts are scored on their structure alone; equal rows get equal
    scores; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(_scores(part, model, "text", length_col))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([length_col] if length_col else []))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD, length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(_scores(part, model, "text", length_col) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op1(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    rows = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
