"""Stored text rollups: batches, replays, compaction, and what a request reads."""

import datetime
import glob
import re

import pytest
from pyspark.sql import functions as F

from presstide.functions import text as tx
from presstide.operators import textrollups as tr
from presstide.operators import textstore as ts
from presstide.operators import trends as td

WORDS = ["rain", "fog", "sun", "wind", "snow", "hail"]


@pytest.fixture(scope="module")
def articles(spark):
    rows = []
    for i in range(120):
        body = " ".join(WORDS[(i * k + k * k) % 6] for k in range(1, 4 + i % 5))
        when = datetime.datetime(2020, 1 + i % 7, 1 + i % 28, i % 24)
        rows.append((f"org,p{i % 5})/{i}", ["en", "de", None][i % 3], when if i % 40 else None, body))
    df = spark.createDataFrame(rows, "hostpath_surt string, language string, timestamp_published timestamp, body string")
    df = tx.with_tokens(df, "body", "language", "tokens")
    from presstide.session import persist_table

    return persist_table(df, "articles")


def rows_of(df):
    shown = df.withColumn(tr.DOCS, F.theta_sketch_estimate(tr.DOCS))
    return sorted((tuple(r) for r in shown.select(*sorted(shown.columns)).collect()), key=repr)


@pytest.mark.parametrize("unit,terms,by_host", [("month", True, False), ("day", False, True), ("day", True, True), ("month", False, False)])
def test_batches_replays_and_compaction(spark, articles, tmp_path, unit, terms, by_host):
    path, args = str(tmp_path / "store"), (unit, terms, by_host)
    part = F.pmod(F.xxhash64("hostpath_surt"), F.lit(3))
    for batch in (0, 1, 1, 2, 0):
        ts.write_batch(ts.build(articles.filter(part == batch), *args), path, unit, batch)
    want = rows_of(ts.build(articles, *args))
    assert rows_of(ts.open_store(spark, path, *args)) == want and len(want) > 5
    whole = ts.compact(spark, path, str(tmp_path / "whole"), *args)
    assert rows_of(ts.open_store(spark, whole, *args, merged=True)) == want
    # What is stored agrees with the rollup that is not.
    plain = tr.text_rollup(articles, unit, terms, by_host)
    stored = ts.counts(ts.open_store(spark, whole, *args, merged=True)).select(*plain.columns)
    assert stored.exceptAll(plain).count() == 0 and plain.exceptAll(stored).count() == 0


def test_empty_batch(spark, articles, tmp_path):
    path = ts.write_batch(ts.build(articles.limit(0), terms=True), str(tmp_path / "store"))
    assert ts.open_store(spark, path, terms=True).count() == 0


def scans(spark, df):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    return re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\], ReadSchema", df._jdf.queryExecution().executedPlan().toString(), re.S)


def test_requests_reach_folders_and_row_groups(spark, articles, tmp_path):
    path = ts.write_batch(ts.build(articles, terms=True), str(tmp_path / "store"))
    for merged in (True, False):
        opened = ts.open_store(spark, path, terms=True, merged=merged)
        request = td.cooccurrence(opened.drop("docs"), ["rain", "fog"], "en", "2020-02-01", "2020-04-01")
        ((folders, groups),) = scans(spark, request)
        assert "language" in folders and "period" in folders and "alltext" in groups


def test_a_span_reads_its_months_alone(spark, articles, tmp_path):
    path = ts.write_batch(ts.build(articles, "day", True), str(tmp_path / "store"), "day")
    some = ts.open_store(spark, path, "day", True, merged=True, lo="2020-03-15", hi="2020-04-02").filter("language = 'en'")
    read = some.select(F.input_file_name().alias("f")).distinct().collect()
    assert {re.search("period=([0-9-]+)", r.f)[1] for r in read} == {"2020-03-01", "2020-04-01"}
    assert all("language=en" in r.f for r in read) and len(read) < len(glob.glob(f"{path}/**/*.parquet", recursive=True)) / 4


def test_one_store_serves_all_requests(spark, articles, tmp_path):
    made = []

    def make():
        made.append(1)
        return ts.write_batch(ts.build(articles, terms=True), str(tmp_path / "store"))

    paths = {ts.once(spark, ("test", str(tmp_path)), make) for _ in range(3)}
    assert len(made) == 1 and len(paths) == 1


@pytest.mark.parametrize("unit,by_host", [("month", False), ("day", True)])
def test_ngrams_of_a_batch_move_once(spark, articles, unit, by_host, monkeypatch):
    monkeypatch.setattr(tr, "ARTICLES_A_TASK", 3)  # several shares a month
    built = ts.build(articles, unit, True, by_host)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "_share" in plan
    plain = tr.text_rollup(articles, unit, True, by_host)
    stored = ts.counts(built).select(*plain.columns)
    assert stored.exceptAll(plain).count() == 0 and plain.exceptAll(stored).count() == 0


def test_family_moves_its_ngrams_once(spark, articles):
    both = tr.text_rollup_family(articles, "month", True)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
    for by_host in (True, False):
        some = both.filter(F.col("by_host") == by_host)
        plain = tr.text_rollup(articles, "month", True, by_host)
        got = some.select(*[c for c in plain.columns if c != tr.DOCS], F.col("docs").alias(tr.DOCS))
        assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0
        sketches = tr.text_rollup(articles, "month", True, by_host, sketch=True)
        assert rows_of(some.select(*sketches.columns)) == rows_of(sketches)


def test_ngrams_move_as_runs_of_their_articles(spark, articles, monkeypatch):
    moved = ts._dealt(articles, "month", 3)
    assert moved.count() == articles.filter("size(tokens) > 0").count()
    monkeypatch.setattr(tr, "ARTICLES_A_TASK", 3)
    assert moved.count() < ts._dealt(articles, "month", 3).count() < tr.keyed(articles, "month", True).count()


def test_shares_hold_every_ngram_once(monkeypatch):
    import collections
    import random

    import pyarrow as pa

    pick = random.Random(5)
    monkeypatch.setattr(tx, "RUN_TOKENS", 40)
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("lexeme", pa.string())]))
    for max_n in (1, 2, 3, 4):
        rows = []
        for _ in range(50):
            places = sorted(pick.sample(range(1, 40), pick.randrange(0, 30)))
            rows.append([{"pos": p, "lexeme": pick.choice(["a", "b", "c", "é", "字", "aa"])} for p in places])
        rows[7] = None
        shares = [pick.choice([1, 3, 9]) for _ in rows]
        vectors = pa.array([[], *rows], kind).slice(1)
        cells = tx._shared_runs(max_n)(vectors, pa.array(shares, pa.int64())).to_pylist()
        got, share_of = collections.Counter(), {}
        for i, cell in [(i, c) for i, row in enumerate(cells) for c in row]:
            for names, number, row in tx.ngram_rows(pa.array([cell["words"]], pa.list_(pa.string())), pa.array([cell["runs"]], pa.list_(pa.string())), max_n):
                names = names.to_pylist()
                assert names == sorted(names, key=str.encode)
                for k in number.tolist():
                    got[i, names[k]] += 1
                    assert share_of.setdefault((shares[i], names[k]), cell["share"]) == cell["share"] < shares[i]
        want = set()
        for i, row in enumerate(rows):
            at = {t["pos"]: t["lexeme"] for t in row or []}
            want |= {(i, " ".join(at[p + k] for k in range(n))) for p in at for n in range(1, max_n + 1) if all(p + k in at for k in range(n))}
        assert set(got) == want and set(got.values()) <= {1}


def test_terms_of_many_articles_by_share(spark):
    when = datetime.datetime(2021, 5, 3)
    rows = [(f"org,p)/{i % 90}" if i % 7 else None, "en", when + datetime.timedelta(days=i % 3), f"storm flood w{i} storm flood") for i in range(150)]
    df = tx.with_tokens(spark.createDataFrame(rows, "hostpath_surt string, language string, timestamp_published timestamp, body string"), "body", "language", "tokens")
    for unit, by_host in (("month", False), ("day", True)):
        built = ts.build(df, unit, True, by_host)
        plain = tr.text_rollup(df, unit, True, by_host)
        got = ts.counts(built).select(*plain.columns)
        assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0
        sketches = tr.text_rollup(df, unit, True, by_host, sketch=True)
        assert rows_of(built.select(*sketches.columns)) == rows_of(sketches)


def exploded(articles, unit, by_host, max_n=3):
    """The rollup by brute force: a row per article and n-gram, grouped."""
    keys = ["alltext", "language", tr.time_key(unit)] + (["host"] if by_host else [])
    rows = tr.keyed(articles, unit, True, max_n).groupBy(*keys).agg(F.count(tr.DOCS).alias("docs"), F.count_distinct(tr.DOCS).alias("urls"))
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def counted(rows):
    keys = [c for c in rows.columns if c not in ("docs", tr.DOCS, "by_host")]
    rows = rows.select(*keys, "docs", F.theta_sketch_estimate(tr.DOCS).alias("urls"))
    return sorted((tuple(r) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("whole_shares", [3, 0])
@pytest.mark.parametrize("unit,by_host", [("month", False), ("day", True)])
def test_folders_of_any_size_count_the_same(spark, articles, monkeypatch, whole_shares, unit, by_host):
    # Some six articles a month: in three shares of the terms each, or as runs of words.
    monkeypatch.setattr(tr, "ARTICLES_A_TASK", 2)
    monkeypatch.setattr(tr, "FOLDER_TASKS", 1)
    monkeypatch.setattr(tr, "WHOLE_SHARES", whole_shares)
    monkeypatch.setattr(tx, "PART_TOKENS", 5)
    rows = articles.unionByName(articles.filter("language = 'de'")).unionByName(articles.limit(4).withColumn("hostpath_surt", F.lit(None).cast("string")))
    want = exploded(rows, unit, by_host)
    built = tr.count_terms(rows, unit, by_host)
    assert counted(built) == want and len(want) > 200
    assert [r[:-1] for r in want] == sorted((tuple(r) for r in tr.text_rollup(rows, unit, True, by_host).collect()), key=repr)
    both = tr.text_rollup_family(rows, unit, True)
    assert counted(both.filter("by_host")) == exploded(rows, unit, True)
    assert counted(both.filter("NOT by_host").drop("host")) == exploded(rows, unit, False)


def test_texts_move_and_not_their_ngrams(spark, articles):
    """The rollups with terms have one shuffle: of a row per article, with its text."""
    texts = articles.drop("tokens")

    def vectors(rows):
        return tx.with_tokens(rows, "body", "language", "tokens")

    for rollup in (tr.text_rollup(texts, "day", True, True, vectors=vectors), tr.text_rollup(texts, "month", True, sketch=True, vectors=vectors), tr.text_rollup_family(texts, "month", True, vectors=vectors)):
        plan = rollup._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        moved = plan[plan.index("Exchange hashpartitioning"):]
        assert "Generate explode(sequence(" in moved and "ArrowEvalPython" not in moved and "transform(" not in moved
    want = tr.text_rollup(articles, "day", True, True)
    got = tr.text_rollup(texts, "day", True, True, vectors=vectors)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_dealt_rows_are_stored_in_order_without_a_sort(spark, articles, tmp_path):
    path = ts.write_batch(ts.build(articles, terms=True), str(tmp_path / "store"), dealt=True)
    files = glob.glob(f"{path}/**/*.parquet", recursive=True)
    assert len(files) > 10
    for f in files:
        terms = [r.alltext for r in spark.read.parquet(f).select("alltext").collect()]
        assert terms == sorted(terms, key=str.encode)
    opened = ts.open_store(spark, path, terms=True, merged=True)
    assert counted(opened) == exploded(articles, "month", False)


def test_ordered_ngrams(monkeypatch):
    import random

    import pyarrow as pa

    pick = random.Random(3)
    monkeypatch.setattr(tx, "PART_TOKENS", 7)
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("lexeme", pa.string())]))
    for max_n in (1, 2, 3, 4):
        rows = []
        for _ in range(40):
            places = sorted(pick.sample(range(1, 40), pick.randrange(0, 30)))
            rows.append([{"pos": p, "lexeme": pick.choice(["a", "b", "c", "é", "字", "aa"])} for p in places])
        rows[7] = None
        vectors = pa.array([[], *rows], kind).slice(1)
        want = set()
        for i, row in enumerate(rows):
            at = {t["pos"]: t["lexeme"] for t in row or []}
            want |= {(" ".join(at[p + k] for k in range(n)), i) for p in at for n in range(1, max_n + 1) if all(p + k in at for k in range(n))}
        for shares in (1, 3):
            got = []
            for share in range(shares):
                of_share = []
                for names, number, row in tx.ordered_ngrams(vectors, max_n, shares, share):
                    of_share += [(names[k].as_py(), i) for k, i in zip(number.tolist(), row.tolist())]
                assert of_share == sorted(of_share, key=lambda x: (x[0].encode(), x[1]))
                got += of_share
            assert len(got) == len(want) and set(got) == want
        assert [len(x[0]) for x in tx.ordered_ngrams(vectors.slice(0, 0), max_n)] == []


def test_lists_of_sketches_unite(spark):
    from presstide.functions import sketches as sk

    ones = [bytes(r.s) for r in spark.range(80).groupBy("id").agg(sk.theta_build("id").alias("s")).orderBy("id").collect()]
    for n in (1, 2, 5, sk.FEW, sk.FEW + 1, 32, 33, 80):
        lists = [ones[i : min(i + 32, n)] for i in range(0, n, 32)]
        row = spark.createDataFrame([(lists,), (None,), ([],)], "l array<array<binary>>").select(F.theta_sketch_estimate(sk.theta_merge_lists("l")).alias("n"))
        assert [r.n for r in row.collect()] == [n, None, None]
