"""Phrase collocations by SETM: sorted occurrence relations, merged, counted and filtered level by level.

The relation of level k says which phrase of k words begins at each position. It is kept
in blocks of some ``BLOCK_BYTES`` of text of one language: an array with one number per
position, in order, the phrase's number within the block or -1 where no phrase begins
that is frequent. A -1 stands between pieces too, so positions that follow one another
lie in one piece.

1. Level 1 is written with each block's own words and their counts.
2. A level's groups are counted: every block sends each of its phrases once, with its
   count there; the sums come from one shuffle by phrase, and the phrases that are
   frequent go back to the blocks that hold them, where the others become -1.
3. The next level is the relation merge-joined with itself at adjacent positions: a
   phrase of k+1 words is two frequent phrases of k words one position apart.

Words are strings until level 1 is counted, then numbers that stand for one (language,
word) each; nothing rests on hashes. No shuffle has more rows for a phrase than there
are blocks, so a word or phrase that is everywhere is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import persist_table

#: Text of a block, unless one document alone has more.
BLOCK_BYTES = 8 << 20
#: Text of a block that is split into words at once.
SPLIT_BYTES = 1 << 20
#: Bits of a block's number within its task, and of a word's within its block. More of
#: either is an error, never a wrong number.
BLOCK_BITS, WORD_BITS = 12, 31
#: Rows that a task hands on at once.
BATCH = 1 << 16
#: What splits pieces, and what splits words.
SPLIT = "[.,;:!?\n-\r]"
BLANK = "[ \t]+"
LEAST, LONGEST, TOP, COVER = 10, 3, 2000, 50


def positions(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of the word at each position, -1 between pieces; the words by number."""
    marked = pc.replace_substring_regex(pc.ascii_lower(texts), SPLIT, " \n ")
    lists = pc.split_pattern_regex(pc.binary_join_element_wise(marked, "\n", " "), BLANK)
    flat = lists.flatten()
    flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    words = coded.dictionary
    mark = pc.index(words, pa.scalar("\n", words.type)).as_py()
    if mark < 0:
        return code, words
    code = np.where(code == mark, -1, code - (code > mark)).astype(np.int32)
    return code, pa.concat_arrays([words.slice(0, mark), words.slice(mark + 1)])


def _runs(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """The texts in runs of about ``most`` bytes."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield texts.slice(a, b - a)


_BLOCK = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("n", pa.int64())])


def relation(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Level 1, a row per block: block, lang, at (positions), words, counts, n (word occurrences).

    A null text is empty, a null language ``und``.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter("text <> ''")

    def block(lang: str, texts: list[pa.Array], number: int) -> pa.RecordBatch | None:
        parts = [positions(run) for t in texts for run in _runs(t, SPLIT_BYTES)]
        words = pa.chunked_array([w for _, w in parts], pa.string()).dictionary_encode().combine_chunks() if parts else None
        if words is None or not len(words):
            return None
        once, ends = words.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum([0] + [len(w) for _, w in parts])
        at = np.concatenate([np.where(c < 0, -1, once[a + np.maximum(c, 0)]) if len(once) > a else c for (c, _), a in zip(parts, ends)]).astype(np.int32)
        counts = np.bincount(at[at >= 0], minlength=len(words.dictionary))
        if number + 1 >> BLOCK_BITS != number >> BLOCK_BITS:
            raise OverflowError("too many blocks in one task")
        row = {"block": [number], "lang": [lang], "at": [at.tobytes()], "words": [words.dictionary], "counts": [counts], "n": [int(counts.sum())]}
        return pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) if f.name not in ("words", "counts") else pa.ListArray.from_arrays([0, len(counts)], pa.array(row[f.name][0], f.type.value_type)) for f in _BLOCK], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        size: dict[str, int] = {}
        number = TaskContext.get().partitionId() << BLOCK_BITS
        if number >> (63 - WORD_BITS):
            raise OverflowError("too many tasks to number their words")

        for batch in batches:
            for lang in pc.unique(batch["lang"]).to_pylist():
                texts = batch["text"].filter(pc.equal(batch["lang"], lang))
                if pa.types.is_large_string(texts.type):
                    texts = texts.cast(pa.string())
                length = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
                # A run of rows ends where the block is full.
                full = (size.get(lang, 0) + np.cumsum(length)) // block_bytes
                cuts = [0, *(np.flatnonzero(np.diff(full)) + 1).tolist(), len(texts)]
                for a, b in zip(cuts, cuts[1:]):
                    if size.get(lang, 0) and full[a] > 0 and (a > 0 or size[lang] + length[0] > block_bytes):
                        if (out := block(lang, held.pop(lang), number)) is not None:
                            number += 1
                            yield out
                        size[lang] = 0
                    held.setdefault(lang, []).append(texts.slice(a, b - a))
                    size[lang] = size.get(lang, 0) + int(length[a:b].sum())
            # Many languages share the room of one task.
            while sum(size.values()) > 4 * block_bytes:
                lang = max(size, key=size.get)
                if (out := block(lang, held.pop(lang), number)) is not None:
                    number += 1
                    yield out
                del size[lang]
        for lang in sorted(held):
            if (out := block(lang, held[lang], number)) is not None:
                number += 1
                yield out

    return rows.mapInArrow(run, "block long, lang string, at binary, words array<string>, counts array<long>, n long")


def _in_batches(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_pydict(columns)
    for k in range(0, whole.num_rows, BATCH):
        yield whole.slice(k, BATCH)


def _word_groups(blocks: DataFrame) -> DataFrame:
    """block, code, lang, word, n: each block's words."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                words, counts = batch["words"][k].values, batch["counts"][k].values
                size = len(words)
                same = {"block": pa.repeat(batch["block"][k], size), "code": pa.array(np.arange(size), pa.int32()), "lang": pa.repeat(batch["lang"][k], size)}
                yield from _in_batches(same | {"word": words, "n": counts})

    return blocks.select("block", "lang", "words", "counts").mapInArrow(run, "block long, code int, lang string, word string, n long")


def _array(value: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(value.as_py(), kind)


def _joined(at: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The relation merge-joined with itself at adjacent positions.

    Positions at which both begin, the number there of the longer phrase, and the pair of
    shorter ones that each number stands for (first * groups + second).
    """
    place = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
    pair = at[place].astype(np.int64) * groups + at[place + 1]
    keys, number = np.unique(pair, return_inverse=True)
    return place, number.astype(np.int32), keys


def _word_columns(k: int) -> list[str]:
    return [f"w{i}" for i in range(1, k + 1)]


def _longer_groups(level: DataFrame, k: int) -> DataFrame:
    """block, code, w1..wk, n: the phrases of k words that a level of k - 1 joins to, by block."""
    names = _word_columns(k)

    def run(batches):
        for batch in batches:
            for b in range(batch.num_rows):
                words = [_array(batch[w][b], np.int64) for w in names[:-1]]
                _, number, keys = _joined(_array(batch["at"][b], np.int32), len(words[0]))
                first, second = keys // max(len(words[0]), 1), keys % max(len(words[0]), 1)
                out = [w[first] for w in words] + [words[-1][second]]
                columns = {"block": pa.repeat(batch["block"][b], len(keys)), "code": pa.array(np.arange(len(keys)), pa.int32())}
                columns |= {n: pa.array(w) for n, w in zip(names, out)}
                yield from _in_batches(columns | {"n": pa.array(np.bincount(number, minlength=len(keys)), pa.int64())})

    return level.mapInArrow(run, f"block long, code int, {', '.join(f'{w} long' for w in names)}, n long")


def _first_level(blocks: DataFrame, frequent: DataFrame) -> DataFrame:
    """Level 1 with its frequent words alone: block, at, w1 (the word of each number). frequent: block, code, id."""

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("code")
        code, ids = right["code"].to_numpy(), right["id"].to_numpy()
        out = {"block": [], "at": [], "w1": []}
        for b in range(left.num_rows):
            at = _array(left["at"][b], np.int32)
            to = np.full(max(int(at.max(initial=-1)), int(code.max(initial=-1))) + 2, -1, np.int32)
            to[code] = np.arange(len(code))
            out["block"].append(left["block"][b].as_py())
            out["at"].append(to[at].tobytes())  # -1 is the last place, which is -1
            out["w1"].append(np.ascontiguousarray(ids, np.int64).tobytes())
        return pa.table({"block": pa.array(out["block"], pa.int64()), "at": pa.array(out["at"], pa.binary()), "w1": pa.array(out["w1"], pa.binary())})

    return blocks.select("block", "at").groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(keep, "block long, at binary, w1 binary")


def _next_level(level: DataFrame, frequent: DataFrame, k: int) -> DataFrame:
    """Level k with its frequent phrases alone, from level k - 1. frequent: block, code."""
    names = _word_columns(k)

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        code = np.sort(right["code"].to_numpy())
        out = {n: [] for n in ("block", "at", *names)}
        for b in range(left.num_rows):
            words = [_array(left[w][b], np.int64) for w in names[:-1]]
            at = _array(left["at"][b], np.int32)
            place, number, keys = _joined(at, len(words[0]))
            to = np.full(len(keys), -1, np.int32)
            to[code] = np.arange(len(code))
            here = np.full(len(at), -1, np.int32)
            here[place] = to[number]
            kept = keys[code]
            size = max(len(words[0]), 1)
            out["block"].append(left["block"][b].as_py())
            out["at"].append(here.tobytes())
            for n, w in zip(names, [*(w[kept // size] for w in words), words[-1][kept % size]]):
                out[n].append(w.tobytes())
        return pa.table({n: pa.array(v, pa.int64() if n == "block" else pa.binary()) for n, v in out.items()})

    schema = ", ".join(["block long", "at binary", *(f"{w} binary" for w in names)])
    return level.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(keep, schema)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """Word occurrences per lang (lang, n), and the frequent phrases of each length.

    Those of one word: w1 (its number), lang, word, a; of k words: w1..wk, a. ``a`` counts
    all occurrences within pieces, overlaps included, and is ``least`` or more.
    """
    blocks = persist_table(relation(docs, text_col, lang_col, block_bytes), "occurrences-1")
    sizes = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    # One shuffle by word (or phrase) both counts and marks the rows that go back to their
    # blocks. The first block's own number for a word is its number everywhere.
    own = F.call_function("shiftleft", F.col("block"), F.lit(WORD_BITS)).bitwiseOR(F.col("code").cast("long"))
    word = Window.partitionBy("lang", "word")
    rows = _word_groups(blocks).withColumn("own", own).withColumns({"a": F.sum("n").over(word), "id": F.min("own").over(word)})
    rows = persist_table(rows.filter(F.col("a") >= least).drop("n"), "frequent-rows-1")
    words = rows.filter("own = id").select(F.col("id").alias("w1"), "lang", "word", "a")
    found = [words]
    if longest == 1:
        return sizes, found
    level = persist_table(_first_level(blocks, rows.select("block", "code", "id")), "level-1")
    for k in range(2, longest + 1):
        names = _word_columns(k)
        groups = _longer_groups(level, k)
        if k == longest:
            last = groups.groupBy(*names).agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
            found.append(persist_table(last, f"frequent-{k}"))
            break
        phrase = Window.partitionBy(*names)
        rows = groups.withColumn("a", F.sum("n").over(phrase)).filter(F.col("a") >= least)
        rows = rows.withColumn("turn", F.row_number().over(phrase.orderBy("block"))).drop("n")
        rows = persist_table(rows, f"frequent-rows-{k}")
        found.append(rows.filter("turn = 1").select(*names, "a"))
        level = persist_table(_next_level(level, rows.select("block", "code"), k), f"level-{k}")
    return sizes, found


def _cuts(found: list[DataFrame], k: int) -> DataFrame:
    """w1..wk, a, cut, l, r, score of every cut of every phrase of k words."""
    names = _word_columns(k)
    out = None
    for cut in range(1, k):
        left = found[cut - 1].select(*_word_columns(cut), F.col("a").alias("l"))
        right = found[k - cut - 1].select(*[F.col(w).alias(n) for w, n in zip(_word_columns(k - cut), names[cut:])], F.col("a").alias("r"))
        rows = found[k - 1].select(*names, "a").join(left, names[:cut]).join(right, names[cut:])
        wide = "cast({} as decimal(19, 0))".format
        score = F.expr(f"(cast(1000000 as decimal(7, 0)) * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})")
        rows = rows.select(*names, "a", F.lit(cut).alias("cut"), "l", "r", score.cast("long").alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, cover: int = COVER, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 words and more.

    A phrase is as good as its worst cut, floor(1000000 a a / (l r)) in exact numbers, the
    first of equal ones. One is dropped if a longer frequent phrase that holds it has
    ``cover`` percent of its occurrences or more. Ties in score and count go by phrase.
    ``top`` None ranks them all. A null text is empty, a null language ``und``; repeated
    rows count each time; an empty table has no phrases. Only the two columns named are read.
    """
    sizes, found = frequent_phrases(docs, least, longest, text_col, lang_col, block_bytes)
    words = found[0]
    ranked = None
    for k in range(2, longest + 1):
        names = _word_columns(k)
        best = _cuts(found, k).groupBy(*names, "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
        inside = None
        for longer in range(k + 1, longest + 1):
            whole = _word_columns(longer)
            parts = F.array(*[F.struct(*[F.col(whole[i + j]).alias(names[j]) for j in range(k)]) for i in range(longer - k + 1)])
            rows = found[longer - 1].select(F.explode(parts).alias("part"), F.col("a").alias("over")).select("part.*", "over")
            inside = rows if inside is None else inside.unionByName(rows)
        if inside is not None:
            most = persist_table(inside.groupBy(*names).agg(F.max("over").alias("over")), "covered")
            best = best.join(most, names, "left").filter(F.col("over").isNull() | (100 * F.col("over") < cover * F.col("a"))).drop("over")
        rows = best
        for w in names:
            label = words.select(F.col("w1").alias("id"), F.col("word").alias(f"_{w}"), F.col("lang").alias(f"lang_{w}"))
            rows = rows.join(label, rows[w] == F.col("id")).drop("id")
        rows = rows.select(F.col("lang_w1").alias("lang"), F.concat_ws(" ", *[f"_{w}" for w in names]).alias("phrase"), "a", "best.l", "best.r", "best.score")
        ranked = rows if ranked is None else ranked.unionByName(rows)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return persist_table(ranked, "ranked").join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12(spark, sf_dir):
    from .common import table

    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT c.lang, c.k, c.phrase, c.a, c.ws, c.cut, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f * r.f) AS score FROM cuts c
      JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.cut], ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.cut + 1:], ' ')),
b AS (SELECT lang, k, phrase, a, arg_min(l, score * 10 + cut) AS l, arg_min(r, score * 10 + cut) AS r, min(score) AS score FROM s GROUP BY lang, k, phrase, a),
o AS (SELECT lang, phrase, max(over) AS over FROM (
        SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a AS over FROM c WHERE k = 3
        UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE k = 3) GROUP BY lang, phrase),
z AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE o.over IS NULL OR b.k = 3 OR 100 * o.over < 50 * b.a),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
x AS (SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM z)
SELECT x.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n, score::BIGINT AS score FROM x JOIN n ON n.lang = x.lang WHERE rank <= 2000
"""
