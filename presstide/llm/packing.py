"""Order-preserving packing: dynamic programming over document and sentence ends.

Documents are laid end to end in the order of their ids, range by range, each
followed by the end id. A range is a Spark partition, and a task walks through its
own in blocks, so memory holds one block (or one longer document), never a range.

Within a block the cuts minimise padding, plus a penalty for a cut inside a
document and a larger one inside a sentence, plus a charge for each sequence. With
D[j] the least cost up to boundary j,

    D[j] = penalty(j) + charge + min over i of D[i] + window - (pos[j] - pos[i])

for pos[j] - pos[i] <= window: a minimum of D[i] + pos[i] over a sliding range, which
a monotone queue yields in constant time. Lengths that are powers of two need no
padding; they are looked up one by one. A block's last sequences are laid out again
with the next block, so only a range has an end; there any token may be a cut.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import id_and_text, slices

WINDOW = 1024
END_ID = 0
#: Tokens laid out at once.
BLOCK_TOKENS = 1 << 18
#: Text encoded at once.
ENCODED_BYTES = 2 << 20
#: Costs in tokens of padding.
CUT_SENTENCE_END, CUT_INSIDE, PER_SEQUENCE = 4.0, 12.0, 4.0
TOKENIZER = "byte_bpe_50k.json"

# Texts whose white space is more than single blanks and line ends between words.
_ODD = r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable bytes
    stand for themselves, the others follow from 256 in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by a byte-level tokenizer file, each distinct word of a run encoded once.

    The byte-level pattern never joins two words: a blank or line end between two
    other characters always begins a new piece. So a text is cut there and the ids of
    its chunks are laid side by side. Likewise a run's distinct chunks are laid end to
    end and encoded as one text, whose ids that begin with a blank or line end begin a
    chunk. The file's vocabulary gives the merge ranks to the quicker of the two
    installed encoders, whose ids are the same (the tests hold whole texts against the
    file's own library). As there, the file's added tokens are split off first and have
    their own ids. Nothing is remembered from one run to the next.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import re

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        vocabulary, added = library.get_vocab(with_added_tokens=False), library.get_added_tokens_decoder()
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token)}
        ranks = {t: i for t, i in ranks.items() if i not in added}
        self.coder = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        # Of two that begin at one place the longer counts.
        self.added = {t.content: i for i, t in sorted(added.items(), key=lambda e: -len(e[1].content))}
        plain = all(not (t.lstrip or t.rstrip or t.single_word) for t in added.values())
        if not plain:
            raise ValueError(f"{path}: added tokens that take white space or whole words alone are not supported")
        self.split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split if self.added else lambda t: [t]
        self.cut = re.compile(r"(?<=\S)(?=[ \n]\S)")
        self.ends = np.zeros(max([*ranks.values(), *added]) + 2, bool)
        self.begins = np.zeros(len(self.ends), bool)
        for token, i in ranks.items():
            self.ends[i] = token.rstrip(b"\"')]").endswith((b".", b"!", b"?")) or b"\n" in token
            self.begins[i] = token.startswith((b" ", b"\n"))

    def _ids_of(self, chunk: str) -> list[int]:
        return [self.added[chunk]] if chunk in self.added else self.coder.encode_ordinary(chunk)

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, where each word's start there and how many they are; words as ``_chunks`` marks them."""
        whole = pc.starts_with(words, "\r")
        own = [self._ids_of(w[1:]) for w in words.filter(whole).to_pylist()]
        rest = words.filter(pc.invert(whole))
        rest = pc.if_else(pc.starts_with(rest, "\n"), rest, pc.binary_join_element_wise("", rest, " "))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest), "")[0].as_py()
        ids = self.coder.encode_to_numpy(text, disallowed_special=()).astype(np.int32) if text else np.zeros(0, np.int32)
        at = np.flatnonzero(self.begins[ids])
        if len(at) != len(rest):
            raise RuntimeError(f"{len(rest)} chunks were encoded as {len(at)}")
        # The chunks taken as they are come after the others; a word's ids start where its place says.
        lens, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        whole = whole.to_numpy(zero_copy_only=False)
        lens[~whole], starts[~whole] = np.diff(at, append=len(ids)), at
        lens[whole] = np.fromiter(map(len, own), np.int64, len(own))
        starts[whole] = len(ids) + np.cumsum(lens[whole]) - lens[whole]
        flat = np.fromiter(chain.from_iterable(own), np.int32, int(lens[whole].sum()))
        return np.concatenate([ids, flat]), starts, lens

    def _pieces(self, text: str) -> list[str]:
        """Chunks of a text; an added token is one by itself."""
        return [c for part in self.split(text) if part for c in ([part] if part in self.added else self.cut.split(part))]

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Marked words of every text and how many each has; ``\\r`` marks a chunk to be taken as it is."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        for token in self.added:
            odd = odd | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if odd.any():
            parts = [self._pieces(t) if o else None for t, o in zip(texts.to_pylist(), odd)]
            plain, n_plain = self._chunks(texts.filter(pa.array(~odd)))
            words, counts, k, i = [], np.zeros(len(texts), np.int64), 0, 0
            counts[~odd] = n_plain
            plain = plain.to_pylist()
            for p in parts:
                if p is None:
                    words.extend(plain[k : k + n_plain[i]])
                    k, i = k + n_plain[i], i + 1
                else:
                    words.extend("\r" + x for x in p)
            counts[odd] = [len(p) for p in parts if p is not None]
            return pa.array(words, pa.string()), counts
        marked = pc.binary_join_element_wise("\r", pc.replace_substring(texts, "\n", " \n"), "")
        lists = pc.split_pattern(marked, " ")
        return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, the end id after each text, and each text's number of ids."""
        words, counts = self._chunks(pc.fill_null(texts, ""))
        coded = words.dictionary_encode()
        pool, starts, lens = self._encoded(coded.dictionary)
        place = coded.indices.to_numpy(zero_copy_only=False)
        starts, lens = starts[place], lens[place]
        upto = np.concatenate([[0], np.cumsum(lens)])
        ids = pool[np.repeat(starts - upto[:-1], lens) + np.arange(upto[-1])]
        last = np.cumsum(counts)
        per_text = upto[last] - upto[last - counts]
        out = np.full(len(ids) + len(texts), END_ID, np.int32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(per_text + 1) - 1] = False
        out[keep] = ids
        return out, per_text + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a file, which a Python worker makes once for all its tasks."""
    return Encoder(path)


def lay_out(pos: list[int], penalty: list[float], window: int = WINDOW, charge: float = PER_SEQUENCE, smallest: int = 1) -> list[int]:
    """Indices of the boundaries at which to cut, first and last included.

    ``pos`` rises from 0 by at most ``window`` a step; ``penalty`` is the cost of a
    cut at each. Ties go to the longest window.
    """
    n = len(pos)
    best, back = [0.0] * n, [0] * n
    place = array("i", [-1]) * (pos[-1] + 1)
    place[0] = 0
    # A full window needs no padding by the queue's rule; the smallest pay only where a range ends.
    powers = [1 << k for k in range(window.bit_length()) if smallest <= 1 << k < window]
    queue: deque[int] = deque([0])
    key = [0.0] * n  # best + pos
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        cost = key[i] + (window - p)
        for w in powers:
            if w > p:
                break
            h = place[p - w]
            if h >= 0 and best[h] < cost:
                cost, i = best[h], h
        cost += penalty[j] + charge
        best[j], back[j] = cost, i
        place[p] = j
        key[j] = k = cost + p
        while queue and key[queue[-1]] > k:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


class Packer:
    """Pieces of a stream of documents; ``first`` is the id of the first sequence."""

    def __init__(self, ends: np.ndarray, first: int, window: int, with_ids: bool):
        self.ends, self.next, self.window, self.with_ids = ends, first, window, with_ids
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # doc_id, tokens of it, of which are packed
        self.held = 0

    def add(self, doc_ids: list, ids: np.ndarray, lens: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.ids.append(ids)
        self.docs.extend((d, n, 0) for d, n in zip(doc_ids, lens.tolist()))
        self.held += len(ids)
        if self.held >= BLOCK_TOKENS:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        ids, window = np.concatenate(self.ids), self.window
        left = np.array([n - done for _, n, done in self.docs], np.int64)
        doc_end = np.cumsum(left)
        cost = np.full(len(ids) + 1, np.inf, np.float32)
        if last:
            cost[max(0, len(ids) - window) :] = CUT_INSIDE
        cost[1:][self.ends[ids]] = CUT_SENTENCE_END
        cost[doc_end] = 0.0
        cost[0] = 0.0
        pos = np.flatnonzero(np.isfinite(cost))
        # A window that is full when it ends inside a sentence.
        full = pos[pos < len(ids) - window] + window
        cost[full] = np.minimum(cost[full], CUT_INSIDE)
        pos = np.flatnonzero(np.isfinite(cost))
        # Where no sentence ends for a whole window, a cut inside it is needed.
        gap = np.diff(pos)
        for i in np.flatnonzero(gap > window):
            cost[np.arange(pos[i] + window, pos[i + 1], window)] = CUT_INSIDE
        pos = np.flatnonzero(np.isfinite(cost))
        at = pos[lay_out(pos.tolist(), cost[pos].tolist(), window, smallest=1 if last else 128)]
        if not last:
            at = at[: max(2, len(at) - 4)]
        yield self._pieces(ids, at, doc_end, left)
        done = int(at[-1])
        k = int(np.searchsorted(doc_end, done, side="right"))
        if k < len(self.docs):
            d, n, packed = self.docs[k]
            before = int(doc_end[k] - left[k])
            self.docs[k] = (d, n, packed + done - before)
        self.docs = self.docs[k:]
        self.ids = [ids[done:]]
        self.held = len(ids) - done

    def _pieces(self, ids: np.ndarray, at: np.ndarray, doc_end: np.ndarray, left: np.ndarray) -> pa.RecordBatch:
        doc_start = doc_end - left
        begin = np.union1d(at[:-1], doc_start[doc_start < at[-1]])
        end = np.append(begin[1:], at[-1])
        doc = np.searchsorted(doc_end, begin, side="right")
        seq = np.searchsorted(at, begin, side="right") - 1
        raw = memoryview(ids.astype("<u4").view(np.uint8))
        packed = np.array([x[2] for x in self.docs], np.int64)
        columns = {
            "doc_id": pa.array([self.docs[i][0] for i in doc.tolist()], pa.int64()),
            "start": pa.array(packed[doc] + begin - doc_start[doc]),
            "length": pa.array(end - begin),
            "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist())], pa.int64()),
            "doc_tokens": pa.array(np.array([x[1] for x in self.docs], np.int64)[doc]),
            "sequence_id": pa.array(self.next + seq),
            "offset": pa.array(begin - at[seq]),
        }
        if self.with_ids:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begin, end[-1]) - begin[0], pa.int32()), pa.array(ids[begin[0] : end[-1]], pa.int32()))
        self.next += len(at) - 1
        return pa.RecordBatch.from_pydict(columns)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: of which document, where it starts there, its sequence and place.

    Sequences hold ``window`` tokens at most. A null or empty text is the end id
    alone. A null id is packed like any other, before all others. Rows that share an
    id are documents of their own. An empty table gives no pieces. Sequence ids are
    unique and rise with the order of documents, with gaps between ranges.
    ``with_ids`` adds the ids of each piece.
    """
    path = tokenizer or TOKENIZER

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = None, None
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                if packer is None:
                    coder = encoder(path if os.path.sep in path else tokenizer_path(path))
                    packer = Packer(coder.ends, TaskContext.get().partitionId() << 40, window, with_ids)
                done = [coder.encode(run["text"]) for run in slices(part, "text", ENCODED_BYTES)]
                ids, lens = (np.concatenate(x) for x in zip(*done))
                yield from packer.add(part["doc_id"].to_pylist(), ids, lens)
        if packer is not None:
            yield from packer.flush(True)

    rows = id_and_text(docs, id_col, text_col)
    # The text's hash spreads rows that share an id.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(packed, SCHEMA + (", ids array<int>" if with_ids else ""))


def op3(spark, sf_dir):
    from .common import table

    return pack(table(spark, sf_dir, "documents"))
