"""Chat formatting by perspective rotation.

A dialogue of several speakers becomes one training dialogue for each of them: that
speaker's turns are the assistant's, everybody else's are those of named users, and
only the assistant's content (with its end mark) is trained on. System turns belong
to nobody and stay in every perspective.

A perspective is a sequence of segments, one row each, with the place of the segment
and of its trained part in the rendered dialogue. So a dialogue of any length is
never one row or one task's group: places are sums over runs of turns, then over
the runs' totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import persist_table

#: Turn numbers of a run whose places are summed together.
RUN = 1024
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>"


def _safe(text: Column) -> Column:
    """Content cannot forge a mark: the bar of ``<|im_`` in it is set apart."""
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def _name(role: Column) -> Column:
    """Letters, marks and digits of all scripts, ``_`` and ``-`` stay; the UTF-8 bytes
    of all else are written as ``%20``. URL decoding gives the role back."""
    kept = r"\A[\p{L}\p{M}\p{N}_-]*\z"
    escaped = F.transform(F.split(role, ""), lambda c: F.when(c.rlike(kept), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", r"%$1")))
    return F.when(role.rlike(kept), role).otherwise(F.array_join(escaped, ""))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, participant, position, turn, role, name, segment, start, end, trained,
    train_start, train_end, speaker: one row per participant and turn. ``name`` is the
    speaker of a user turn as ``_name`` writes it, ``speaker`` whose turn it is.

    Participants are a conversation's distinct roles but ``system``; a null role is
    the participant ``unknown``, a null text empty. Turns are ordered by number, null
    first, ties by role and text. ``segment`` joined over a participant's positions is
    the dialogue; start and end (exclusive) are its characters there. train_start and
    train_end are equal where nothing is trained. Turns without a conversation id are
    one conversation. A conversation of system turns alone has no participants, so no
    rows; repeated turns stay; an empty table gives an empty result.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(role_col, F.lit("unknown")).alias("speaker"), _safe(F.coalesce(text_col, F.lit(""))).alias("content"),
    )
    # Stored, so that the turns of a very long conversation are split among tasks.
    who = persist_table(rows.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("p_conv"), F.col("speaker").alias("participant")).distinct(), "participants")
    rows = rows.join(who, F.col("conv_id").eqNullSafe(F.col("p_conv"))).drop("p_conv")

    own = F.col("speaker") == F.col("participant")
    role = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    name = F.when(role == "user", _name(F.col("speaker")))
    rows = rows.withColumns({"role": role, "name": name, "run": F.floor(F.col("turn") / F.lit(RUN))})
    head = F.concat(F.lit(START), F.col("role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    rows = rows.withColumns({"head": head, "segment": F.concat(head, F.col("content"), F.lit(END + "\n"))})
    rows = rows.withColumn("length", F.length("segment").cast("long"))

    keys = ["conv_id", "participant"]
    inside = Window.partitionBy(*keys, "run").orderBy(F.col("turn").asc_nulls_first(), "speaker", "content").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({"p_in": F.coalesce(F.count("length").over(inside), zero), "s_in": F.coalesce(F.sum("length").over(inside), zero)})
    totals = rows.groupBy(*keys, "run").agg(F.count("*").alias("n"), F.sum("length").alias("size"))
    before = Window.partitionBy(*keys).orderBy(F.col("run").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("conv_id").alias("t_conv"), F.col("participant").alias("t_who"), F.col("run").alias("t_run"),
        F.coalesce(F.sum("n").over(before), zero).alias("p_before"), F.coalesce(F.sum("size").over(before), zero).alias("s_before"),
    )
    totals = persist_table(totals, "run-totals")
    same = F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("participant") == F.col("t_who")) & F.col("run").eqNullSafe(F.col("t_run"))
    rows = rows.join(totals, same).withColumn("start", F.col("s_before") + F.col("s_in"))
    trained = F.col("role") == "assistant"
    first = F.col("start") + F.length("head")
    return rows.select(
        "conv_id", "participant", (F.col("p_before") + F.col("p_in")).alias("position"), "turn", "role", "name", "segment",
        "start", (F.col("start") + F.col("length")).alias("end"), trained.alias("trained"),
        F.when(trained, first).otherwise(F.col("start")).alias("train_start"),
        F.when(trained, first + F.length("content") + len(END)).otherwise(F.col("start")).alias("train_end"), "speaker",
    )


def op4(spark, sf_dir):
    from .common import table

    # The check SQL has no column for it; names tell speakers apart.
    return rotate(table(spark, sf_dir, "conversations")).drop("speaker")


OP4_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '< |im_') AS content FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> 'system'),
r AS (SELECT t.*, participant,
             CASE WHEN speaker = participant THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, CASE WHEN role = 'user' THEN array_to_string(list_transform(regexp_extract_all(speaker, '(?s).'), lambda c:
             CASE WHEN regexp_full_match(c, '[\p{L}\p{M}\p{N}_-]') THEN c ELSE regexp_replace(hex(encode(c)), '(..)', '%\1', 'g') END), '') END AS name FROM r),
s AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM h),
g AS (SELECT *, head || content || '<|im_end|>' || chr(10) AS segment FROM s),
w AS (SELECT *, (row_number() OVER o - 1)::BIGINT AS position, (sum(length(segment)) OVER o)::BIGINT AS "end" FROM g
      WINDOW o AS (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, content ROWS UNBOUNDED PRECEDING))
SELECT conv_id, participant, position, turn, role, name, segment, "end" - length(segment) AS start, "end", role = 'assistant' AS trained,
       "end" - length(segment) + CASE WHEN role = 'assistant' THEN length(head) ELSE 0 END AS train_start,
       CASE WHEN role = 'assistant' THEN "end" - 1 ELSE "end" - length(segment) END AS train_end
FROM w
"""
