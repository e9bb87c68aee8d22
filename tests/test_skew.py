"""One key holds most rows: the plans must reduce or split it."""

import pytest
from pyspark.sql import functions as F

from presstide.operators import captures as cp
from presstide.session import persist_table
from presstide.sources import crawlindex as ci


@pytest.fixture()
def tiny_skew_limits(spark):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        # A split takes a share of the map tasks, so they must not be merged into one.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return df._jdf.queryExecution().executedPlan().toString(), rows


def hot(spark, n=40000):
    """Two thirds of the rows share one address."""
    return spark.range(n).select(
        F.concat(F.lit("C-"), (F.col("id") % 3).cast("string")).alias("crawl"),
        F.col("id").alias("line_no"),
        F.when(F.col("id") % 3 < 2, "https://hot.test/front").otherwise(F.concat(F.lit("https://a.test/"), F.col("id").cast("string"))).alias("url"),
        F.lit("text/html").alias("mime"),
        F.lit("200").alias("status"),
        F.sha2(F.col("id").cast("string"), 256).alias("pad"),
    ).repartition(6)


def test_outcome_join_splits_the_hot_key(spark, tiny_skew_limits):
    plan, rows = final_plan(ci.label_outcomes(persist_table(hot(spark), "hot")))
    assert "skew=true" in plan
    assert sum(r.outcome == "kept" and r.hostpath == "hot.test/front" for r in rows) == 1
    assert len(rows) == 40000


def test_latest_ties_splits_the_hot_key(spark, tiny_skew_limits):
    df = persist_table(hot(spark).withColumn("ts", F.lit(1)), "hot")
    plan, rows = final_plan(cp.latest_ties(df, "url", "ts"))
    assert "skew=true" in plan and len(rows) == 40000


def test_ranked_edges_split_the_hot_source(spark, tiny_skew_limits):
    from presstide.operators import links

    edges = spark.range(30000).select(
        F.when(F.col("id") % 3 < 2, "test,hot)").otherwise(F.concat(F.lit("test,h"), F.col("id").cast("string"), F.lit(")"))).alias("src"),
        F.sha2(F.col("id").cast("string"), 256).alias("dest"),
        *[F.lit(1).alias(c) for c in ("src_url", "src_hostpathquery", "src_hostpath")],
    )
    ranks = spark.createDataFrame([(4, "hot.test")], "rank int, host string")
    out = links.weighted_inlinks(persist_table(edges.repartition(6), "edges"), ranks)
    plan, rows = final_plan(out)
    assert "skew=true" in plan
    assert sum(abs(r.src_url - 0.25) < 1e-9 for r in rows) == 20000


def test_insert_absent_splits_the_hot_key(spark, tiny_skew_limits):
    new = persist_table(hot(spark), "new")
    old = persist_table(spark.createDataFrame([("https://a.test/2",), ("https://x.test",)], "url string"), "old")
    plan, rows = final_plan(cp.insert_absent(new, old, [["url"]]))
    assert "skew=true" in plan and len(rows) == 39999


def test_lemma_lookup_splits_the_hot_word(spark, tiny_skew_limits):
    from presstide.functions import text as tx

    docs = spark.range(400).select("id", F.lit("en").alias("lang"), F.concat(
        F.array_join(F.array_repeat(F.lit("ran"), 80), " "), F.lit(" x"), F.col("id").cast("string")).alias("t"))
    docs = persist_table(tx.with_tokens(docs, "t", "lang", stops={}), "docs")
    lemmas = spark.createDataFrame([("en", "ran", "run")], "lang string, form string, lemma string")
    plan, rows = final_plan(tx.with_lemmas(docs, "id", "tokens", "lang", lemmas))
    assert "skew=true" in plan
    assert all([x.lexeme for x in r.tokens] == ["run"] * 80 + [f"x{r.id}"] for r in rows) and len(rows) == 400


def test_first_by_reduces_before_the_shuffle(spark):
    df = hot(spark)
    out = cp.first_by(df, ["url"], ["line_no"])
    assert out.filter("url = 'https://hot.test/front'").first().line_no == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_hot_title_settles_in_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(cp, "SETTLED_AT_ONCE", 0)
    rounds = []
    persist = cp.persist_table
    monkeypatch.setattr(cp, "persist_table", lambda df, label: (rounds.append(label), persist(df, label))[1])
    rows = spark.range(20000).select(
        F.col("id").alias("seq"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("hostpath_surt"), F.lit("h").alias("host"),
        F.when(F.col("id") % 3 < 2, "Not found").otherwise(F.col("id").cast("string")).alias("title"),
    )
    assert cp.first_wins(rows, "seq").count() == 20000 // 3 + 1
    assert rounds.count("first-wins-kept") <= 2
