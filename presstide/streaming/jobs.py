"""Continuous ingest, incremental rollups and first-wins dedup on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import ledger
from ..operators import rollups as ru


def file_stream(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_batch: int | None = None, **options
) -> DataFrame:
    """Files under ``path`` as they arrive, each read once per checkpoint."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def _start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_ingest(
    stream: DataFrame, captures_path: str, ledger_path: str, checkpoint: str, once: bool = True, articles_path: str | None = None
) -> StreamingQuery:
    """Append each batch of captures, its ledger rows and its articles; replays overwrite themselves.

    Rows of sources finished before a batch are left out of it.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        ledger.append_batch(ledger.unfinished(batch, batch_id, ledger_path), batch_id, captures_path, ledger_path, articles_path=articles_path)

    return _start(stream, handle, checkpoint, once)


def stream_rollup(stream: DataFrame, spec: ru.RollupSpec, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep a rollup current: each batch adds its own sketches.

    Batches are stored apart and merged on reading (:func:`read_rollup`), so
    a batch costs only its own rows; :func:`compact_rollup` folds them when
    many have gathered. Late rows need no watermark, as sketches of any time
    still merge.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        ru.build(batch, spec).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return _start(stream, handle, checkpoint, once)


def read_stored(
    spark: SparkSession, spec: ru.RollupSpec, target: str, compacted: str | None = None, upto: int = -1
) -> DataFrame:
    """Merged sketches of a compacted rollup, if any, and the batches after it."""
    parts = spark.read.parquet(target).filter(F.col("batch") > upto).drop("batch")
    if compacted:
        parts = parts.unionByName(spark.read.parquet(compacted))
    return ru.combine(parts, spec)


def read_rollup(
    spark: SparkSession, spec: ru.RollupSpec, target: str, with_rows: bool = False, compacted: str | None = None, upto: int = -1
) -> DataFrame:
    return ru.finalize(read_stored(spark, spec, target, compacted, upto), spec, with_rows)


def compact_rollup(
    spark: SparkSession, spec: ru.RollupSpec, target: str, out: str, upto: int, compacted: str | None = None, after: int = -1
) -> None:
    """Fold batches ``after < batch <= upto``, and an earlier compaction, into ``out``.

    The batches stay where they are; a reader that names ``out`` skips them.
    """
    parts = spark.read.parquet(target).filter((F.col("batch") > after) & (F.col("batch") <= upto)).drop("batch")
    if compacted:
        parts = parts.unionByName(spark.read.parquet(compacted))
    ru.combine(parts, spec).write.mode("errorifexists").parquet(out)


def stream_dedup(
    stream: DataFrame, key: str, ts: str, lateness: str, existing: DataFrame, target: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """First arrival per key: state within the lateness, stored keys beyond it.

    Stored keys are those of ``existing`` and of the batches before this one,
    so a replayed batch is compared with the same keys again.
    """
    fresh = stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])
    known = existing.select(key)

    def handle(batch: DataFrame, batch_id: int) -> None:
        seen = known
        if batch_id > 0:
            earlier = batch.sparkSession.read.parquet(target).filter(F.col("batch") < batch_id)
            seen = known.unionByName(earlier.select(key))
        # Stored keys are read as they are; a repeated one changes no anti-join.
        batch.join(seen, key, "left_anti").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return _start(fresh, handle, checkpoint, once)


def tumbling_counts(stream: DataFrame, ts: str, window: str, keys: list[str], lateness: str) -> DataFrame:
    """Rows per key and tumbling window; works on a stream or a table."""
    if stream.isStreaming:
        stream = stream.withWatermark(ts, lateness)
    return (
        stream.groupBy(F.window(ts, window).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), *keys, "n")
    )
