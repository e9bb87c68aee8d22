"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a shuffled order, twice over. A document
finishes at (its source's words so far, itself included) / (the source's target).
Documents are taken by finish time until the budget of words is used up, so all
sources run out of their targets at the same moment, finish time 1.

Nothing is collected and no source is one group: a source's queue is cut into
``BUCKETS`` ranges of the shuffle hash whose sums give each range its start, and
the global order is cut by two histograms of the finish time before the few
entries around the cut are ordered exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, persist_table, unused

#: Hex digits of the shuffle hash that name a range of a source's queue.
BUCKET_DIGITS = 3
#: Steps of a histogram of finish times.
STEPS = 4096


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> and rank, target.

    Sources are ranked by code point, null last, and weigh ``weights`` in turn.
    They share ``share`` of all words by weight; a target stops at ``most`` times
    its source's size and what is over goes to the others by weight. Taken in
    order of cap / weight, sources are capped as long as the level that the rest would
    reach by weight is above their own; from then on it is the level of all. One row per source goes through one window.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    rows = ranked.withColumns({"w": w, "cap": cap}).withColumn("level", F.col("cap") / F.col("w"))
    every = Window.partitionBy()
    before = Window.orderBy("level", "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.floor(F.sum("source_size").over(every) * F.lit(float(share))) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("reach", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # The first source that is not capped tells the level of all that follow.
    first = F.min(F.when(F.col("reach") <= F.col("level"), F.struct("level", "rank", "reach"))).over(every)
    rows = rows.withColumn("common", first["reach"])
    target = F.coalesce(F.least(F.col("common") * F.col("w"), F.col("cap")), F.col("cap"))
    return rows.select("source", "source_size", "rank", target.alias("target"))


def _cut(entries: DataFrame, budget: int) -> tuple[float, int, int]:
    """The entry (finish, rank, words of it) at which the budget ends.

    ``entries``: finish, rank, size > 0. Two histograms narrow the place to
    1 / STEPS**2 of the queue; the rest is ordered by (finish, rank), which no two
    entries share.
    """
    low, width, used = 0.0, 2.0, 0
    for _ in range(2):
        step = width / STEPS
        # Everything beyond the range is one last step; before it, all is taken.
        at = F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit(step)), F.lit(STEPS)).cast("int")
        inside = entries.filter(F.col("finish") >= F.lit(low))
        sums = inside.groupBy(at.alias("step")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.orderBy("step")) + F.lit(used)
        here = sums.select("step", "size", upto.alias("upto")).filter(F.col("upto") >= F.lit(budget)).orderBy("step").first()
        if here is None:
            return float("inf"), 0, 0
        if here["step"] == STEPS:
            low, width, used = low + STEPS * step, float("inf"), here["upto"] - here["size"]
            break
        low, width, used = low + here["step"] * step, step, here["upto"] - here["size"]
    near = entries.filter((F.col("finish") >= F.lit(low)) & (F.col("finish") <= F.lit(low + width)))
    order = Window.orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = near.withColumn("upto", F.sum("size").over(order) + F.lit(used)).filter(F.col("upto") >= F.lit(budget)).orderBy("finish", "rank").first()
    return last["finish"], last["rank"], last["size"] - (last["upto"] - budget)


def queue(docs: DataFrame, size: Column, keep: list[str], weights=(5, 2, 1), share: float = 1.5, repeats: int = 2, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """keep columns, size, source, source_size, target, taken: the words the mix takes, repeats counted.

    ``size`` is the words of a row. Rows of size 0 take nothing. Rows that agree in
    id, source and size queue one after the other and may take different shares.
    A null id is one more id, a null source one more source. An empty table gives
    an empty result.
    """
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    narrow = docs.select(*keep, F.col(source_col).alias("source"), size.alias("size"), shuffled.alias("draw"))
    narrow = persist_table(narrow.withColumn("part", F.substring("draw", 1, BUCKET_DIGITS)), "mix-sizes")
    parts = persist_table(narrow.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "mix-parts")
    goals = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, float(repeats))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("part_size").over(before), F.lit(0))).withColumnRenamed("source", "g_source").drop("part_size")
    goals = goals.withColumnRenamed("source", "g_source")
    starts = starts.join(goals.withColumnRenamed("g_source", "s"), F.col("g_source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("part", "g_part")
    rows = narrow.join(starts, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("part") == F.col("g_part"))).drop("g_source", "g_part")
    within = Window.partitionBy("source", "part").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.col("start") + F.sum("size").over(within))
    rows = persist_table(rows.drop("draw", "part", "start"), "mix-queue")

    total = rows.agg(F.sum("size")).first()[0] or 0
    finish = [(F.lit(k) * F.col("source_size") + F.col("upto")) / F.col("target") for k in range(repeats)]
    full = rows.filter((F.col("size") > 0) & (F.col("target") > 0))
    entries = full.select(F.explode(F.array(*finish)).alias("finish"), "rank", "size")
    budget = int(total * share // 1)
    end, rank, part = _cut(entries, budget) if budget else (0.0, 0, 0)
    took = F.lit(0).cast("long")
    for f in finish:
        place = F.struct(f.alias("f"), F.col("rank").alias("r"))
        edge = F.struct(F.lit(float(end)).alias("f"), F.lit(int(rank)).alias("r"))
        took = took + F.when((F.col("size") <= 0) | (F.col("target") <= 0), 0).when(place < edge, F.col("size")).when(place == edge, F.lit(int(part))).otherwise(0)
    return rows.select(*keep, "size", "source", "source_size", "target", took.cast("long").alias("taken"))


def mixed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The rows of the mix with all columns of ``docs``: each document as often as it is taken.

    The one document at which the budget ends may be taken in part; then its last copy
    is its first words, set one blank apart, and ``length_col`` is the length of that.
    Texts move once, to their row of the queue. Only rows that share an id are numbered,
    by (id, source, size) in the order of a hash of their text. A null text has no words
    and is never taken; a null id is one more id; an empty table gives none. Columns of
    ``docs`` may have any names.
    """
    size, turn, copy, text, q_id, q_source, q_size, q_taken, q_turn = unused(
        docs, "mix_size", "mix_turn", "mix_copy", "mix_text", "q_id", "q_source", "q_size", "q_taken", "q_turn"
    )
    taken = queue(docs, words(text_col), [id_col], id_col=id_col, source_col=source_col, **options)
    taken = taken.select(F.col(id_col).alias(q_id), F.col("source").alias(q_source), F.col("size").alias(q_size), F.col("taken").alias(q_taken))
    taken = persist_table(taken, "mix-taken")
    # Rows of which nothing is taken leave here; of size 0 there is nothing to take.
    same_id = F.col(id_col).eqNullSafe(F.col(q_id))
    many = persist_table(taken.groupBy(q_id).agg(F.count("*").alias(q_size)).filter(F.col(q_size) > 1).select(q_id), "mix-shared-ids")
    shared = not many.isEmpty()
    alone = taken.join(many.withColumnRenamed(q_id, size), F.col(q_id).eqNullSafe(F.col(size)), "left_anti") if shared else taken
    rows = docs.join(alone.filter(F.col(q_taken) > 0).hint("merge"), same_id).select(*docs.columns, q_size, q_taken)
    if shared:
        keys = [id_col, source_col, size]
        sized = docs.join(many, same_id, "left_semi").withColumn(size, words(text_col))
        sized = sized.withColumn(turn, F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(text_col))))
        turns = taken.join(many.withColumnRenamed(q_id, size), F.col(q_id).eqNullSafe(F.col(size)), "left_semi")
        turns = turns.withColumn(q_turn, F.row_number().over(Window.partitionBy(q_id, q_source, q_size).orderBy(F.col(q_taken).desc()))).filter(F.col(q_taken) > 0)
        same = same_id & F.col(source_col).eqNullSafe(F.col(q_source)) & (F.col(size) == F.col(q_size)) & (F.col(turn) == F.col(q_turn))
        rows = rows.unionByName(sized.join(turns, same).select(*docs.columns, q_size, q_taken))
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(F.col(q_taken) / F.col(q_size)).cast("int"))))
    rest = F.col(q_taken) - (F.col(copy) - 1) * F.col(q_size)
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), rest.cast("int")), " ")
    out = rows.withColumn(text, F.when(rest < F.col(q_size), part).otherwise(F.col(text_col)))
    if length_col is not None:
        out = out.withColumn(length_col, F.when(rest < F.col(q_size), F.length(text)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return out.withColumn(text_col, F.col(text)).select(*docs.columns)


def op5(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return queue(docs, words("text"), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "source")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (floor(sum(source_size) OVER () * 1.5::DOUBLE)
                 - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS reach FROM w),
c1 AS (SELECT reach AS common FROM l WHERE reach <= cap / w ORDER BY cap / w, rank LIMIT 1),
g AS (SELECT source, source_size, rank, least(coalesce((SELECT common FROM c1) * w, cap), cap) AS target FROM l),
q AS (SELECT d.*, g.source_size, g.rank, g.target,
             sum(size) OVER (PARTITION BY d.source ORDER BY draw, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT doc_id, k, size, (k * source_size + upto) / target AS finish, rank FROM q, (VALUES (0), (1)) t(k) WHERE size > 0 AND target > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, rank ROWS UNBOUNDED PRECEDING) - size AS before FROM e),
t AS (SELECT doc_id, sum(least(greatest((SELECT floor(sum(size) * 1.5) FROM d)::BIGINT - before, 0), size))::BIGINT AS taken FROM c GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken, q.source FROM q LEFT JOIN t USING (doc_id)
"""
