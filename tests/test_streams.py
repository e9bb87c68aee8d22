import os

import pytest
from pyspark.sql import functions as F

from presstide.functions import urlkeys as uk
from presstide.operators import ledger
from presstide.operators import rollups as ru
from presstide.session import persist_table, scratch_dir
from presstide.streaming import jobs

SCHEMA = "id int, id_source string, ts timestamp, url string"


def rows(lo, hi):
    return [
        (i, f"s{i % 3}", f"2024-01-{i % 9 + 1:02d} 0{i % 10}:00:00", f"https://h{i % 4}.test/p{i % 11}") for i in range(lo, hi)
    ]


def frame(spark, lo, hi):
    return spark.createDataFrame(rows(lo, hi), "id int, id_source string, t string, url string").select(
        "id", "id_source", F.col("t").cast("timestamp").alias("ts"), "url"
    )


def test_ledger_counts_replays_once(spark):
    captures, book = scratch_dir(spark, "c"), scratch_dir(spark, "l")
    for batch in (0, 1, 1):
        ledger.append_batch(frame(spark, batch * 10, batch * 10 + 10), batch, captures, book)
    assert spark.read.parquet(captures).count() == 20
    state = {r.source: r for r in ledger.read_ledger(spark, book).collect()}
    assert sum(r.urls_inserted for r in state.values()) == 20 and all(r.finished_at is None for r in state.values())
    found = spark.createDataFrame([("s0",), ("s1",), ("new",)], "source string")
    # The batch id of an append: its counts stay.
    ledger.finish_sources(spark, found.filter("source = 's1'"), book, 1)
    assert {r.source: r.urls_inserted for r in ledger.read_ledger(spark, book).collect()} == {s: r.urls_inserted for s, r in state.items()}
    left = {r.source: r.urls_inserted for r in ledger.pending(found, ledger.read_ledger(spark, book)).collect()}
    assert left == {"s0": state["s0"].urls_inserted, "new": 0}


def test_archive_refuses_to_replace(spark):
    path = scratch_dir(spark, "a")
    df = frame(spark, 0, 5).select("url", F.lit("test,h)").alias("surt"), F.lit("C-1").alias("crawl"))
    ledger.write_archive(df, path)
    with pytest.raises(Exception, match="already exists"):
        ledger.write_archive(df, path)
    ledger.write_archive(df.limit(2), path, force=True)
    assert spark.read.parquet(path).count() == 2


def test_ingest_takes_each_file_once(spark):
    files, captures, book, check = (scratch_dir(spark, x) for x in ("f", "c", "l", "k"))
    frame(spark, 0, 30).repartition(3).write.parquet(files)

    def run():
        stream = jobs.file_stream(spark, files, SCHEMA, files_per_batch=1)
        jobs.stream_ingest(stream, captures, book, check).awaitTermination()
        return spark.read.parquet(captures).count()

    assert run() == 30
    assert run() == 30
    frame(spark, 30, 40).coalesce(1).write.mode("append").parquet(files)
    assert run() == 40
    assert sum(r.urls_inserted for r in ledger.read_ledger(spark, book).collect()) == 40


def test_streamed_rollup_equals_batch(spark):
    files, target, check = (scratch_dir(spark, x) for x in ("f", "t", "k"))
    df = persist_table(frame(spark, 0, 200), "all")
    df.repartition(5).write.parquet(files)
    spec = ru.RollupSpec({"host_name": uk.url_host("url")}, ru.url_measures("url", True))
    jobs.stream_rollup(jobs.file_stream(spark, files, SCHEMA, files_per_batch=2), spec, target, check).awaitTermination()
    assert len(os.listdir(target.replace("file:", ""))) == 3
    expected = sorted(map(tuple, ru.rollup(df, spec, with_rows=True).collect()))
    assert sorted(map(tuple, jobs.read_rollup(spark, spec, target, with_rows=True).collect())) == expected
    one, two = scratch_dir(spark, "folded"), scratch_dir(spark, "folded")
    jobs.compact_rollup(spark, spec, target, one, upto=0)
    jobs.compact_rollup(spark, spec, target, two, upto=1, compacted=one, after=0)
    for folded, upto in ((one, 0), (two, 1)):
        got = jobs.read_rollup(spark, spec, target, with_rows=True, compacted=folded, upto=upto)
        assert sorted(map(tuple, got.collect())) == expected


def test_stream_dedup_within_and_across_batches(spark):
    files, out, check = (scratch_dir(spark, x) for x in ("f", "o", "k"))
    frame(spark, 0, 60).repartition(4).write.parquet(files)
    known = spark.createDataFrame([("https://h0.test/p0",)], "url string")

    def run():
        stream = jobs.file_stream(spark, files, SCHEMA, files_per_batch=1)
        jobs.stream_dedup(stream, "url", "ts", "30 days", known, out, check).awaitTermination()
        return sorted(r.url for r in spark.read.parquet(out).collect())

    expected = sorted({r[3] for r in rows(0, 60)} - {"https://h0.test/p0"})
    assert run() == expected
    # Long after the state for these keys is gone, the stored keys still count.
    late = frame(spark, 0, 60).withColumn("ts", F.col("ts") + F.expr("INTERVAL 400 DAYS"))
    late.coalesce(1).write.mode("append").parquet(files)
    assert run() == expected


def test_windows_in_batch_and_stream(spark):
    files, out = scratch_dir(spark, "f"), scratch_dir(spark, "o")
    df = frame(spark, 0, 60)
    df.coalesce(1).write.parquet(files)
    counts = jobs.tumbling_counts(jobs.file_stream(spark, files, SCHEMA), "ts", "1 day", ["id_source"], "1 day")
    counts.writeStream.outputMode("append").format("parquet").option("path", out).option(
        "checkpointLocation", scratch_dir(spark, "k")
    ).trigger(availableNow=True).start().awaitTermination()
    whole = jobs.tumbling_counts(df, "ts", "1 day", ["id_source"], "1 day")
    closed = whole.filter("window_start + INTERVAL 1 DAY <= TIMESTAMP '2024-01-08 09:00:00'")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.read.schema(counts.schema).parquet(out)) == key(closed)


def test_scratch_folder_is_shared_or_refused(spark, monkeypatch):
    from presstide import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Cluster:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(Cluster())
    Context.master = "local[2]"
    assert session.scratch_root(Cluster()) == session.scratch_root(Cluster())
