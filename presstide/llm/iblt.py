"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines; a longer line after each ``RUN`` words) and
stands for the set of their 64-bit digests. A sketch has three tables of s
cells; a digest is put into one cell of each, where the count, the digests and their
checks add up (the latter two by exclusive or). Two sketches subtract cell by cell,
what both texts share cancels, and peeling recovers the rest: a cell that holds one
digest, as its check tells, gives it away, and it is taken out of its other cells.

A difference too large for the sketch stops the peeling; then it is tried again with
larger tables, on the digests dealt by their high bits into parts of about ``PART``,
so that the work grows with the text. All of this is array expressions within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import id_and_text, persist_table

#: Words of a paragraph at most.
RUN = 48
#: Cells in each table of the stored fingerprint, and of the sketches tried after it.
STORED, SIZES = 4, (8, 16, 32, 64, 128, 512, 4096, 65536)
#: Digests in a part, and rounds of peeling (each takes out all that is alone).
PART, ROUNDS = 8, 24
#: Ids of a bucket of neighbouring documents.
SPAN = 256

_PARAGRAPH = rf"(?:\S++[ \t]++){{0,{RUN - 1}}}\S++\s*+|\s++"


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs; all of the text is in one of them."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _cell(count: Column, key: Column, check: Column) -> Column:
    return F.struct(count.alias("c"), key.alias("k"), check.alias("h"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _entries(keys: Column, s: Column) -> Column:
    """Each digest with its cells and check; ``s``, cells a table, is a power of two."""
    place = lambda k, j: (F.shiftrightunsigned(k, 16 * j).bitwiseAND(s - 1) + s * j).cast("int")
    return F.transform(keys, lambda k: F.struct(*[place(k, j).alias(f"at{j}") for j in range(3)], k.alias("k"), F.xxhash64(k).alias("h")))


def _merged(cell: Column, i: Column, entry: Column, sign: Column) -> Column:
    """Cell number ``i`` after ``entry`` is added (sign 1) or taken out (-1)."""
    mine = (i == entry["at0"]) | (i == entry["at1"]) | (i == entry["at2"])
    return F.when(mine, _cell(cell["c"] + sign, cell["k"].bitwiseXOR(entry["k"]), cell["h"].bitwiseXOR(entry["h"]))).otherwise(cell)


def sketch(keys: Column, s: Column) -> Column:
    """The 3 s cells of an array of digests."""
    empty = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    numbers = F.sequence(F.lit(0), (s * 3 - 1).cast("int"))
    return _let(_entries(keys, s), lambda all_: F.transform(numbers, lambda i: F.aggregate(all_, empty, lambda cell, e: _merged(cell, i, e, F.lit(1)))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["c"] - y["c"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])))


def peel(cells: Column, s: Column) -> Column:
    """struct(left, right): the digests only one side had; null if some cells stay."""
    none = F.array().cast("array<bigint>")
    state = lambda c, a, b, on: F.struct(c.alias("cells"), a.alias("left"), b.alias("right"), on.alias("on"))
    alone = lambda x: (F.abs(x["c"]) == 1) & (x["h"] == F.xxhash64(x["k"]))

    def take(now: Column, found: Column) -> Column:
        left = F.when(found["c"] == 1, F.array_append(now["left"], found["e"]["k"])).otherwise(now["left"])
        right = F.when(found["c"] == -1, F.array_append(now["right"], found["e"]["k"])).otherwise(now["right"])
        return state(F.transform(now["cells"], lambda x, i: _merged(x, i, found["e"], -found["c"])), left, right, F.lit(True))

    def turn(now: Column, _: Column) -> Column:
        ones = F.filter(now["cells"], alone)
        found = F.array_distinct(F.transform(ones, lambda x: F.struct(_entries(F.array(x["k"]), s)[0].alias("e"), x["c"].alias("c"))))
        return F.when(now["on"], F.aggregate(found, state(now["cells"], now["left"], now["right"], F.lit(False)), take)).otherwise(now)

    def result(end: Column) -> Column:
        clean = F.forall(end["cells"], lambda x: (x["c"] == 0) & (x["k"] == 0))
        return F.when(clean, F.struct(end["left"].alias("left"), end["right"].alias("right")))

    return _let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(cells, none, none, F.lit(True)), turn), result)


def _decode(a: Column, b: Column, s: Column) -> Column:
    return peel(subtract(sketch(a, s), sketch(b, s)), s)


def _retried(a: Column, b: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """By the first size whose sketches peel. If none does (two digests that agree in
    48 bits), the arrays as they are: wholly different."""
    nothing = F.lit(None).cast("struct<left:array<bigint>,right:array<bigint>>")
    tried = F.aggregate(
        F.array(*[F.lit(x).cast("long") for x in sizes]), nothing, lambda done, s: F.when(done.isNotNull(), done).otherwise(_decode(a, b, s))
    )
    return F.coalesce(tried, F.struct(a.alias("left"), b.alias("right")))


def _bits(x: Column, low: Column, n: Column) -> Column:
    """``n`` bits of ``x`` from bit ``low`` on."""
    return F.call_function("shiftrightunsigned", x, low).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1)


def parts(keys: list[Column], size: int = PART) -> Column:
    """The arrays of digests dealt by their high bits, which no place in a table depends
    on, into parts that hold about ``size`` of the longest array: array of struct(p0, p1, ..).

    Dealt in two steps, so that n digests take about n times the square root of the
    number of parts.
    """
    names = [f"p{i}" for i in range(len(keys))]
    most = F.greatest(*[F.size(k) for k in keys], F.lit(size))
    bits = F.ceil(F.log2(most / size)).cast("int")
    first = F.floor(bits / 2).cast("int")

    def deal(one: Column, low: Column, n: Column) -> Column:
        numbers = F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1)
        return F.transform(numbers, lambda i: F.struct(*[F.filter(one[c], lambda x: _bits(x, low, n) == i).alias(c) for c in names]))

    def dealt(b: Column) -> Column:
        groups = deal(b["keys"], F.lit(64) - b["first"], b["first"])
        return F.flatten(F.transform(groups, lambda g: deal(g, F.lit(64) - b["bits"], b["bits"] - b["first"])))

    every = F.struct(*[k.alias(c) for k, c in zip(keys, names)])
    return _let(F.struct(bits.alias("bits"), first.alias("first"), every.alias("keys")), lambda b: F.when(b["bits"] == 0, F.array(b["keys"])).otherwise(dealt(b)))


def differences(keys: Column, others: list[Column]) -> Column:
    """For each of ``others`` struct(left, right): the digests that only ``keys`` has, and
    only the other. Part by part, by subtracting and peeling sketches, larger on failure."""
    s = F.lit(SIZES[0]).cast("long")
    names = [f"p{i + 1}" for i in range(len(others))]

    def compared(p: Column) -> Column:
        own = lambda mine: F.struct(*[F.coalesce(peel(subtract(mine, sketch(p[c], s)), s), _retried(p["p0"], p[c], SIZES[1:])).alias(c) for c in names])
        return _let(sketch(p["p0"], s), own)

    def joined(each: Column) -> Column:
        side = lambda c, of: F.flatten(F.transform(each, lambda x: x[c][of])).alias(of)
        return F.struct(*[F.struct(side(c, "left"), side(c, "right")).alias(c) for c in names])

    return _let(F.transform(parts([keys, *others]), compared), joined)


def difference(a: Column, b: Column) -> Column:
    """struct(left, right): the digests of one array only."""
    return differences(a, [b])["p1"]


def stored(keys: Column) -> Column:
    """The sketch that is kept as a document's fingerprint."""
    return sketch(keys, F.lit(STORED).cast("long"))


def fingerprint(keys: Column, cells: Column) -> Column:
    """The stored sketch as text: digests, then each cell's count, digests and checks."""
    written = F.transform(cells, lambda x: F.concat_ws(".", x["c"].cast("string"), F.lower(F.hex(x["k"])), F.lower(F.hex(x["h"]))))
    return F.concat(F.size(keys).cast("string"), F.lit(":"), F.concat_ws(",", written))


def likeness(shared_of: Column, a: Column, b: Column) -> Column:
    """Twice the shared digests over all of both, 0 to 1; of two empty texts 1."""
    total = F.size(a) + F.size(b)
    lost = _let(shared_of, lambda d: F.size(d["left"]) + F.size(d["right"]))
    return F.when(total == 0, 1.0).otherwise((total - lost) / total)


def _range(key: Column, span: int) -> Column:
    """floor(key / span) in whole numbers; a double would merge large ids."""
    n = F.lit(span).cast("long")
    return F.call_function("div", key - F.pmod(key, n), n)


def next_keys(keys: DataFrame, span: int = SPAN) -> DataFrame:
    """key, next of distinct numbers: the next larger one, of the largest the least.

    Keys are looked up within ranges of ``span``; the last of each range takes the
    first of the next range that has any, found among the ranges in the same way. So
    no window holds more than ``span`` keys, however they are spread.
    """
    keys = persist_table(keys.select(F.col("key").cast("long").alias("key")), "keys")
    ends = keys.agg(F.min("key").alias("least"), F.min(_range(F.col("key"), span)).alias("low"), F.max(_range(F.col("key"), span)).alias("high")).first()
    # From the lowest on, so that ranges of ranges end in one.
    grouped = keys.withColumn("range", _range(F.col("key"), span) - F.lit(ends["low"] or 0).cast("long"))
    within = Window.partitionBy("range").orderBy("key")
    found = grouped.withColumn("next", F.lead("key").over(within))
    if ends["low"] is None or ends["low"] == ends["high"]:
        return found.select("key", F.coalesce("next", F.lit(ends["least"]).cast("long")).alias("next"))
    firsts = persist_table(grouped.groupBy("range").agg(F.min("key").alias("first")), "ranges")
    after = next_keys(firsts.select(F.col("range").alias("key")), span)
    after = after.join(firsts, F.col("next") == F.col("range")).select(F.col("key").alias("range"), "first")
    found = found.join(after, "range")
    return found.select("key", F.coalesce("next", "first").alias("next"))


def with_next(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, text -> also next_text, the text of the next document by id.

    The last is followed by the first. Rows that share an id follow each other by
    text. Texts move once, to the bucket of their id; of each bucket the first text is
    also sent to the bucket before.
    """
    bucket = _range(F.col("doc_id"), span)
    ids = docs.select("doc_id").withColumn("bucket", bucket)
    buckets = persist_table(ids.groupBy("bucket").agg(F.min("doc_id").alias("least")), "buckets")
    after = next_keys(buckets.select(F.col("bucket").alias("key")), span)
    before = persist_table(after.select(F.col("next").alias("bucket"), F.col("key").alias("before")), "bucket-order")

    inside = Window.partitionBy("bucket").orderBy("doc_id", "text")
    rows = docs.withColumn("bucket", bucket).withColumns({"place": F.row_number().over(inside), "following": F.lead("text").over(inside)})
    firsts = rows.filter("place = 1").select("bucket", F.col("text").alias("first_text")).join(before, "bucket")
    firsts = firsts.select(F.col("before").alias("b_bucket"), "first_text")
    out = rows.join(firsts, (F.col("bucket") == F.col("b_bucket")) & F.col("following").isNull(), "left")
    return out.select("bucket", "doc_id", "text", F.coalesce("following", "first_text").alias("next_text"))


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    Edited: the last half of the code points (rounded down) replaced by as many from
    the start of the next document, or all it has. A null text is empty; an empty one
    has no paragraphs. A null id comes first. An empty table gives an empty result.
    """
    rows = id_and_text(docs, id_col, text_col)
    least = rows.agg(F.min("doc_id")).first()[0] or 0
    none = F.lit(max(least, 1 - 2**63) - 1).cast("long")
    rows = with_next(rows.withColumn("doc_id", F.coalesce("doc_id", none))).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("changed"), digests(F.col("next_text")).alias("after"),
    )
    rows = rows.withColumns({f"{c}_cells": stored(F.col(c)) for c in ("own", "changed", "after")})
    s = F.lit(STORED).cast("long")
    # The stored sketches tell close versions apart; what they cannot is tried larger.
    rows = rows.withColumns({f"{c}_peeled": peel(subtract(F.col("own_cells"), F.col(f"{c}_cells")), s) for c in ("changed", "after")})
    done = F.col("changed_peeled").isNotNull() & F.col("after_peeled").isNotNull()
    larger = F.when(~done, differences(F.col("own"), [F.col("changed"), F.col("after")]))
    rows = rows.withColumn("larger", larger)
    return rows.select(
        F.when(F.col("doc_id") > none, F.col("doc_id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own"), F.col("own_cells")).alias("fingerprint"),
        fingerprint(F.col("changed"), F.col("changed_cells")).alias("edited_fingerprint"),
        likeness(F.coalesce("changed_peeled", F.col("larger.p1")), F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.coalesce("after_peeled", F.col("larger.p2")), F.col("own"), F.col("after")).alias("near_next"),
    )


def op10(spark, sf_dir):
    from .common import table

    return versions(table(spark, sf_dir, "documents"))
