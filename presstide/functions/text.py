"""Positioned tokens and n-grams, as expressions over one row's own text.

A token vector is ``array<struct<pos:int,lexeme:string>>`` sorted by position.
Positions count every token; stop words are removed afterwards, so gaps stay
and n-grams never bridge a removed word.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import persist_table
from .urlkeys import as_col

FALLBACK_LANGUAGE = "xx"

# Extra stop words for Korean.
KOREAN_EXTRA_STOPS = ["이거", "이것", "는", "은", "가", "이", "을", "를", "기", "에"]

# Small default lists; callers pass their own for real archives.
DEFAULT_STOPS: dict[str, list[str]] = {
    "en": "the of and to in a is that for it on was with be as by this are at an or from".split(),
    "fr": "le la les de des du et un une en que qui dans par pour sur au ce il".split(),
    "de": "der die das und ein eine in zu den von mit auf für im ist nicht auch".split(),
    "es": "el la los las de del y un una en que por con para no se al lo".split(),
    "ko": KOREAN_EXTRA_STOPS,
    FALLBACK_LANGUAGE: [],
}


def raw_words(text: Column | str) -> Column:
    """Lower-case words without punctuation, symbols and control characters.

    Line breaks and tabs become blanks first, so words on two lines stay two.
    """
    t = F.lower(as_col(text))
    t = F.regexp_replace(t, r"\p{Cc}", " ")
    t = F.regexp_replace(t, r"[\p{P}\p{S}\p{C}]", "")
    return F.filter(F.split(t, r"[\s\p{Z}]+"), lambda w: w != "")


def number_words(words: Column | str) -> Column:
    return F.transform(
        as_col(words),
        lambda w, i: F.struct((i + 1).cast("int").alias("pos"), w.alias("lexeme")),
    )


def drop_stops(tokens: Column | str, lang: Column | str, stops: Mapping[str, Sequence[str]]) -> Column:
    """Remove each language's stop words; other languages use the fallback list.

    The lists become literal hash sets in the plan, which suits lists; a whole
    dictionary is better joined as a table of empty lemmas by :func:`with_lemmas`.
    """
    t, code = as_col(tokens), as_col(lang)

    def keep(words):
        return F.filter(t, lambda x: ~x["lexeme"].isin(list(words))) if words else t

    chain = None
    for language in sorted(k for k in stops if k != FALLBACK_LANGUAGE):
        kept = keep(stops[language])
        chain = F.when(code == language, kept) if chain is None else chain.when(code == language, kept)
    rest = keep(stops.get(FALLBACK_LANGUAGE, []))
    return rest if chain is None else F.when(code.isNotNull(), chain.otherwise(rest))


def with_tokens(
    df: DataFrame,
    text_col: str,
    lang_col: str,
    out_col: str = "tokens",
    stops: Mapping[str, Sequence[str]] = DEFAULT_STOPS,
) -> DataFrame:
    """Add the token vector of ``text_col``; null text or language gives null."""
    df = df.withColumn(out_col, number_words(raw_words(text_col)))
    return df.withColumn(out_col, drop_stops(out_col, lang_col, stops))


def with_lemmas(
    df: DataFrame, id_col: str, tokens_col: str, lang_col: str, lemmas: DataFrame
) -> DataFrame:
    """Replace forms by lemmas from a (lang, form, lemma) table of any size.

    A form missing for its language is looked up under the fallback language,
    then kept as it is; an empty lemma removes the token. Rows are spread by
    document first, while each is still one row, so that putting the tokens
    back together needs no second shuffle when the table is small enough for
    Spark to broadcast it. The other columns travel on the first token only.
    ``id_col`` must be unique and not null.
    """
    forms = (
        lemmas.dropDuplicates(["lang", "form"])
        .groupBy(F.col("form").alias("_form"))
        .agg(F.map_from_entries(F.collect_list(F.struct("lang", "lemma"))).alias("_by_lang"))
    )
    forms = persist_table(forms, "forms")
    others = [c for c in df.columns if c not in (id_col, tokens_col)]
    whole = F.struct(*others, F.col(tokens_col).isNotNull().alias("_has"))
    # The other columns sit in the exploded array, beside the first token only;
    # as columns of their own they would be copied out with every token.
    vector = F.coalesce(tokens_col, F.array().cast("array<struct<pos:int,lexeme:string>>"))
    carried = F.explode(F.arrays_zip(vector.alias("t"), F.array(whole).alias("r"))).alias("_x")
    exploded = (
        df.repartition(id_col)
        .select(id_col, F.col(lang_col).alias("_lang"), carried)
        .select(id_col, "_lang", F.col("_x.r").alias("_row"), F.col("_x.t.pos").alias("pos"), F.col("_x.t.lexeme").alias("lexeme"))
    )
    lemma = F.coalesce(
        F.col("_by_lang")[F.col("_lang")], F.col("_by_lang")[FALLBACK_LANGUAGE], F.col("lexeme")
    )
    rebuilt = F.array_sort(
        F.collect_list(F.when(F.col("lemma") != "", F.struct("pos", F.col("lemma").alias("lexeme"))))
    )
    return (
        exploded.join(forms, F.col("lexeme") == F.col("_form"), "left")
        .withColumn("lemma", lemma)
        .groupBy(id_col)
        .agg(F.first("_row", ignorenulls=True).alias("_row"), rebuilt.alias("_v"))
        .select(
            id_col,
            *[F.col(f"_row.`{c}`").alias(c) for c in others],
            F.when(F.col("_row._has"), F.col("_v")).alias(tokens_col),
        )
    )


def explode_tokens(df: DataFrame, tokens_col: str, *keep: str | Column) -> DataFrame:
    """One row per token: ``keep`` columns, pos, lexeme.

    The outer form is used and its empty rows dropped after: for the inner one
    the optimizer adds a filter on the vector's size, and pushing that down
    works the whole vector out again.
    """
    return df.select(*keep, F.inline_outer(tokens_col).alias("pos", "lexeme")).filter("lexeme IS NOT NULL")


def lexemes(tokens: Column | str) -> Column:
    """Distinct lexemes of a vector."""
    return F.array_distinct(F.transform(as_col(tokens), lambda x: x["lexeme"]))


def concat_tokens(first: Column | str, second: Column | str) -> Column:
    """Append a vector, its positions shifted past the first one's last."""
    a, b = as_col(first), as_col(second)
    shift = F.coalesce(F.array_max(F.transform(a, lambda x: x["pos"])), F.lit(0))
    # The shift is laid beside the tokens, so it is worked out once per row.
    shifted = F.zip_with(
        b,
        F.array_repeat(shift, F.size(b)),
        lambda x, by: F.struct((x["pos"] + by).cast("int").alias("pos"), x["lexeme"].alias("lexeme")),
    )
    return F.concat(a, shifted)


def ngrams(tokens: Column | str, max_n: int = 3, min_n: int = 1, unique: bool = True) -> Column:
    """All runs of ``min_n``..``max_n`` tokens at consecutive positions.

    The vector is laid beside itself shifted by 1, 2, ... tokens, so each
    token sees those before it and the row is walked once. No lambda looks
    back at the whole vector: were its expression inlined there, it would be
    worked out again for every token.
    """
    t = as_col(tokens)
    none = F.lit(None).cast("struct<pos:int,lexeme:string>")
    moved = [F.concat(F.array_repeat(none, back), t) for back in range(1, max_n)]
    beside = F.arrays_zip(*[c.alias(f"t{k}") for k, c in enumerate([t, *moved])])

    def ending_here(row):
        grams = []
        adjacent = row["t0"]["lexeme"].isNotNull()
        for size in range(1, max_n + 1):
            if size > 1:
                adjacent = adjacent & F.coalesce(
                    row[f"t{size - 1}"]["pos"] == row["t0"]["pos"] - (size - 1), F.lit(False)
                )
            if size >= min_n:
                words = [row[f"t{k}"]["lexeme"] for k in reversed(range(size))]
                grams.append(F.when(adjacent, F.concat_ws(" ", *words)))
        return F.array(*grams)

    grams = F.array_compact(F.flatten(F.transform(beside, ending_here)))
    return F.array_distinct(grams) if unique else grams


def _first_runs(max_n: int):
    """For Arrow batches of vectors: a number per token, whose bit k says that the run of
    k + 1 tokens ending there is at consecutive positions and stands nowhere before in its row."""

    def marks(vectors):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        flat, row = vectors.flatten(), pc.list_parent_indices(vectors).to_numpy(zero_copy_only=False)
        coded = flat.field("lexeme").dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pos = flat.field("pos").to_numpy(zero_copy_only=False)
        out, n_words = np.zeros(len(word), np.int32), max(len(coded.dictionary), 1)
        steps = np.zeros(len(word), bool)
        steps[1:] = (row[1:] == row[:-1]) & (pos[1:] == pos[:-1] + 1)
        # run: the number, in its row, of the run of this size that ends at a place; -1: there is none.
        _, first, run = np.unique(row * n_words + word, return_index=True, return_inverse=True)
        for size in range(max_n):
            if size:
                ends = np.flatnonzero(steps)
                ends = ends[run[ends - 1] >= 0]
                # A run's number is that of one row alone, so row by row nothing is mixed.
                _, first, again = np.unique(run[ends - 1] * n_words + word[ends], return_index=True, return_inverse=True)
                run = np.full(len(word), -1)
                run[ends], first = again, ends[first]
            out[first] |= 1 << size
        offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))

    return marks


def explode_ngrams(df: DataFrame, tokens_col: str, out_col: str, max_n: int = 3) -> DataFrame:
    """One row per distinct n-gram of a row, in place of its token vector; as exploding :func:`ngrams`.

    N-grams outnumber all else, and expressions with lambdas cost several times as
    much for each. So which runs are a row's first of their kind is told on numbers,
    in Arrow batches of vectors, and tokens beside those before them become rows,
    where flat expressions make the runs. Words of these vectors hold no blanks.
    """
    others = [c for c in df.columns if c != tokens_col]
    t = F.col("_tokens")
    none = F.lit(None).cast("struct<pos:int,lexeme:string>")
    marks = F.arrow_udf(_first_runs(max_n), "array<int>")(as_col(tokens_col))
    moved = [F.concat(F.array_repeat(none, back), t).alias(f"_t{back}") for back in range(1, max_n)]
    beside = F.arrays_zip(t.alias("_t0"), *moved, F.col("_marks"))
    rows = df.select(*others, as_col(tokens_col).alias("_tokens"), marks.alias("_marks"))
    rows = rows.select(*others, F.inline_outer(beside).alias(*[f"_t{k}" for k in range(max_n)], "_marks"))
    runs = [
        F.when(F.col("_marks").bitwiseAND(1 << n) != 0, F.concat_ws(" ", *[F.col(f"_t{k}.lexeme") for k in reversed(range(n + 1))]))
        for n in range(max_n)
    ]
    return rows.select(*others, F.stack(F.lit(max_n), *runs).alias(out_col)).filter(F.col(out_col).isNotNull())


#: Tokens whose runs are laid out at once.
RUN_TOKENS = 1 << 20


def _adjacent(row, pos):
    """Per token of flattened vectors: it follows the one before it, at the next position of the same row."""
    import numpy as np

    out = np.zeros(len(row), bool)
    out[1:] = (row[1:] == row[:-1]) & (pos[1:] == pos[:-1] + 1)
    return out


def _shared_runs(max_n: int):
    """For Arrow batches of vectors and numbers of shares: per row, its shares' distinct words and its
    runs of 2 to ``max_n`` words. A run is as long as it can be and stands for all its beginnings."""

    def part(vectors, shares):
        import zlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        flat, row = vectors.flatten(), pc.list_parent_indices(vectors).to_numpy(zero_copy_only=False)
        coded = flat.field("lexeme").dictionary_encode()
        names, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        follows = _adjacent(row, flat.field("pos").to_numpy(zero_copy_only=False))
        first = np.unique(row * max(len(names), 1) + word, return_index=True)[1]
        begin = np.flatnonzero(follows[1:]) if max_n > 1 else np.zeros(0, np.int64)
        parts, goes = [names.take(pa.array(word[begin]))], np.ones(len(begin), bool)
        for size in range(1, max_n):
            at = np.minimum(begin + size, len(word) - 1)
            goes = goes & (begin + size < len(word)) & follows[at] if len(word) else goes
            parts.append(names.take(pa.array(word[at], mask=~goes)))
        runs = pc.binary_join_element_wise(*parts, " ", null_handling="skip") if max_n > 1 else names.slice(0, 0)
        # Cells are the shares of each row, numbered row by row.
        n = shares.to_numpy(zero_copy_only=False).astype(np.int64)
        cell_0 = np.cumsum(n) - n
        word_cell, run_cell = cell_0[row[first]], cell_0[row[begin]]
        if n.max(initial=1) > 1:
            h = np.fromiter((zlib.crc32(w.encode()) for w in names.to_pylist()), np.uint64, len(names)) * np.uint64(0x9E3779B97F4A7C15)
            pair = (h[word[begin]] ^ (h[word[begin]] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[word[begin + 1]]
            for cells, key, of in ((word_cell, h[word[first]], row[first]), (run_cell, pair, row[begin])):
                cells += ((key >> np.uint64(32)) % n[of].astype(np.uint64)).astype(np.int64)
        used, cell = np.unique(np.concatenate([word_cell, run_cell]), return_inverse=True)
        used_row = np.searchsorted(cell_0 + n, used, side="right")

        def lists(cells, take):
            offsets = np.concatenate([[0], np.cumsum(np.bincount(cells, minlength=len(used)))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), take(np.argsort(cells, kind="stable")))

        words = lists(cell[: len(first)], lambda order: names.take(pa.array(word[first][order])))
        runs = lists(cell[len(first) :], lambda order: runs.take(pa.array(order)))
        share = pa.array((used - cell_0[used_row]).astype(np.int32))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(used_row, minlength=len(vectors)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([share, words, runs], ["share", "words", "runs"]))

    def dealt(vectors, shares):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // RUN_TOKENS)) + 1
        cuts = [0, *cuts.tolist(), len(vectors)]
        return pa.concat_arrays([part(vectors.slice(a, b - a), shares.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])

    return dealt


def explode_shares(df: DataFrame, tokens_col: str, shares_col: str, max_n: int = 3) -> DataFrame:
    """One row per row of ``df`` and share of its n-grams that it has any of: ``_share``, ``_words``, ``_runs``.

    ``shares_col`` says into how many shares a row's n-grams are dealt; those of one text
    lie in the same share of all rows with that number. A word goes by itself, longer ones
    by their first two words, all those beginning at a token in one string. So they move as
    some three times the text, where each n-gram by itself, with its keys, takes far more.
    Words of these vectors hold no blanks.
    """
    others = [c for c in df.columns if c not in (tokens_col, shares_col)]
    kind = "array<struct<share:int,words:array<string>,runs:array<string>>>"
    dealt = F.arrow_udf(_shared_runs(max_n), kind)(as_col(tokens_col), as_col(shares_col))
    # Outer, and the empty rows dropped after, as in explode_tokens.
    rows = df.select(*others, dealt.alias("_dealt"))
    return rows.select(*others, F.inline_outer("_dealt").alias("_share", "_words", "_runs")).filter("_share IS NOT NULL")


def ngram_rows(words, runs, max_n: int = 3):
    """For Arrow lists of a share's words and runs: per size of n-gram, their names in order, and
    ``(number of the name, row)`` of each n-gram of each row, once."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n_rows = max(len(words), 1)
    split = pc.split_pattern(runs.flatten(), " ")
    coded = pa.concat_arrays([words.flatten(), split.flatten()]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    names, rank = coded.dictionary.take(order), np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    code = rank[coded.indices.to_numpy(zero_copy_only=False)]
    n_words, row = len(names), pc.list_parent_indices(words).to_numpy(zero_copy_only=False)

    def once(number, row):
        both = np.unique(number * n_rows + row)
        return both // n_rows, both % n_rows

    yield names, *once(code[: len(row)], row)
    long = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    row = pc.list_parent_indices(runs).to_numpy(zero_copy_only=False)
    at = len(code) - long.sum() + np.cumsum(long) - long
    number, shorter = code[at], names
    for size in range(2, max_n + 1):
        goes = long >= size
        long, row, at, number = long[goes], row[goes], at[goes], number[goes]
        both, number = np.unique(number * n_words + code[at + size - 1], return_inverse=True)
        # A blank sorts before whatever a word may hold, so numbers rise as the names do.
        shorter = pc.binary_join_element_wise(shorter.take(pa.array(both // max(n_words, 1))), names.take(pa.array(both % max(n_words, 1))), " ")
        yield shorter, *once(number, row)


#: Tokens whose n-grams are counted at once.
PART_TOKENS = 1 << 17


def _once(values):
    """The values in order, each once."""
    import numpy as np

    values = np.sort(values)
    return values[np.diff(values, prepend=-1) != 0]


def ordered_ngrams(vectors, max_n: int = 3, shares: int = 1, share: int = 0):
    """For Arrow vectors of rows: part by part, names of n-grams in order, and ``(number of the name, row)``
    of each n-gram of each row, once, in order.

    Of ``shares`` shares of the n-grams, by their first words, only the one of number ``share``.
    All n-grams that begin with a word are in one part, and sort before those of the next word.
    """
    import zlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    flat, row = vectors.flatten(), pc.list_parent_indices(vectors).to_numpy(zero_copy_only=False)
    coded = flat.field("lexeme").dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    names, rank = coded.dictionary.take(order), np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    # Words are numbered from 1; 0 is none.
    word = rank[coded.indices.to_numpy(zero_copy_only=False)]
    follows = _adjacent(row, flat.field("pos").to_numpy(zero_copy_only=False))
    n_rows, base = max(len(vectors), 1), len(names) + 1
    begins = np.argsort(word, kind="stable")
    if shares > 1:
        mine = np.fromiter((zlib.crc32(w.encode()) % shares == share for w in names.to_pylist()), bool, len(names))
        begins = begins[mine[word[begins] - 1]]
    first = word[begins]
    new_word = np.flatnonzero(np.diff(first, prepend=-1))
    # Parts end where a word does.
    cuts = new_word[np.flatnonzero(np.diff(new_word // PART_TOKENS, prepend=-1))]
    for a, b in zip(cuts, np.append(cuts[1:], len(begins))):
        at = begins[a:b]
        words, goes = [word[at]], np.ones(len(at), bool)
        for size in range(1, max_n):
            there = np.minimum(at + size, len(word) - 1)
            goes = goes & (at + size < len(word)) & follows[there]
            words.append(np.where(goes, word[there], 0))
        lowest = int(words[0][0])
        if (int(words[0][-1]) - lowest + 1) * base ** (max_n - 1) < 1 << 62:
            key = words[0] - lowest
            for w in words[1:]:
                key = key * base + w
            order = np.argsort(key, kind="stable")
        else:
            order = np.lexsort(words[::-1])
        words, rows = [w[order] for w in words], row[at[order]]
        # An n-gram begins where one of its words changes; a shorter one sorts before those it begins.
        starts, members, new = [], [], np.zeros(len(order), bool)
        new[0] = True
        for w in words:
            new[1:] |= w[1:] != w[:-1]
            begun = new & (w > 0)
            starts.append(np.flatnonzero(begun))
            members.append((np.cumsum(begun) - 1, np.flatnonzero(w > 0)))
        start, size = np.concatenate(starts), np.repeat(np.arange(max_n), [len(x) for x in starts])
        placed = np.lexsort((size, start))
        number = np.empty(len(placed), np.int64)
        number[placed] = np.arange(len(placed))
        offset = np.cumsum([0, *[len(x) for x in starts]])
        both = _once(np.concatenate([number[offset[k] + gram[held]] * n_rows + rows[held] for k, (gram, held) in enumerate(members)]))
        start, size = start[placed], size[placed]
        parts = [names.take(pa.array(w[start] - 1, mask=size < k)) for k, w in enumerate(words)]
        yield pc.binary_join_element_wise(*parts, " ", null_handling="skip"), both // n_rows, both % n_rows


def runs_in_order(words, runs, max_n: int = 3):
    """What :func:`ngram_rows` gives, as one part in order of the names."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names, numbers, rows = zip(*ngram_rows(words, runs, max_n))
    offset = np.cumsum([0, *[len(x) for x in names[:-1]]])
    names, n_rows = pa.concat_arrays(names), max(len(words), 1)
    order = pc.sort_indices(names)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    both = _once(np.concatenate([rank[n + o] * n_rows + r for n, o, r in zip(numbers, offset, rows)]))
    yield names.take(order), both // n_rows, both % n_rows


def parse_vector(text: Column | str) -> Column:
    """Text form ``'lexeme':1,9 ...`` to a token vector; weighted positions skipped."""

    def one(item):
        lexeme = F.btrim(F.split_part(item, F.lit(":"), F.lit(1)), F.lit("'"))
        positions = F.filter(
            F.split(F.split_part(item, F.lit(":"), F.lit(2)), ","), lambda p: p.rlike(r"^\d+$")
        )
        return F.transform(
            positions, lambda p: F.struct(p.cast("int").alias("pos"), lexeme.alias("lexeme"))
        )

    items = F.filter(F.split(as_col(text), r"\s+"), lambda x: x != "")
    return F.array_sort(F.flatten(F.transform(items, one)))


def vector_text(tokens: Column | str) -> Column:
    """Token vector as ``lexeme:pos`` items joined by blanks."""
    return F.array_join(
        F.transform(as_col(tokens), lambda x: F.concat_ws(":", x["lexeme"], x["pos"].cast("string"))),
        " ",
    )


def query_text(tokens: Column | str) -> Column:
    """Token vector as a conjunctive query, ``a & b & c``."""
    return F.array_join(F.transform(as_col(tokens), lambda x: x["lexeme"]), " & ")
