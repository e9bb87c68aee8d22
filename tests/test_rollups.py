import pytest
from pyspark.sql import functions as F

from presstide.functions import sketches as sk
from presstide.operators import lists, quality
from presstide.operators import rollups as ru


def rows_of(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


@pytest.fixture(scope="module")
def facts(spark):
    return spark.range(5000).select(
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("h"), (F.col("id") % 7).cast("string"))).alias("host"),
        F.concat(F.lit("https://h"), (F.col("id") % 7).cast("string"), F.lit(".test/p"), (F.col("id") % 900).cast("string"),
                 F.lit("?utm_x=1&v="), (F.col("id") % 2).cast("string")).alias("url"),
        "id",
    )


@pytest.mark.parametrize("kind", ["theta", "hll"])
def test_merged_halves_equal_the_whole(spark, facts, kind):
    spec = ru.RollupSpec({"site": F.col("host")}, ru.url_measures("url", True), kind=kind)
    whole = ru.rollup(facts, spec, with_rows=True)
    halves = ru.merge(ru.build(facts.filter("id < 1234"), spec), ru.build(facts.filter("id >= 1234"), spec), spec)
    got, expected = rows_of(ru.finalize(halves, spec, with_rows=True), "site"), rows_of(whole, "site")
    assert len(got) == 7
    if kind == "theta":
        assert got == expected
    for a, b in zip(got, expected):
        # A merged HLL sketch uses a slightly coarser estimator.
        assert a[0] == b[0] and a[-1] == b[-1]
        assert a[1:] == pytest.approx(b[1:], rel=0.03)


def test_theta_is_exact_and_hll_close(facts):
    spec = ru.RollupSpec({"host": F.col("host")}, ru.url_measures("url"))
    assert rows_of(ru.rollup(facts, spec), "host") == rows_of(ru.rollup_exact(facts, spec), "host")
    hll = ru.RollupSpec({"host": F.col("host")}, ru.url_measures("url"), kind="hll")
    checked = ru.rollup_checked(facts, hll).collect()
    assert all(r.url_ok and r.hostpath_ok and r.hostpathquery_ok for r in checked)


def test_key_and_measure_names_differ():
    with pytest.raises(ValueError, match="host"):
        ru.RollupSpec({"host": None}, {"host": None})


def test_null_only_measure_counts_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "k string, v string")
    spec = ru.RollupSpec({"k": F.col("k")}, {"v": F.col("v")})
    assert rows_of(ru.rollup(df, spec), "k") == [("a", 0), ("b", 1)]


def test_where_filters_before_counting(facts):
    spec = ru.RollupSpec({}, {"url": F.col("url")}, where=F.col("id") < 10)
    assert ru.rollup(facts, spec, with_rows=True).first() == (10, 10)


def test_one_hot_key_is_reduced_before_the_shuffle(facts):
    spec = ru.RollupSpec({"k": F.lit("all")}, ru.url_measures("url"))
    plan = ru.build(facts.withColumn("k", F.lit(1)), spec)._jdf.queryExecution().executedPlan().toString()
    assert "partial_theta_sketch_agg" in plan


def test_value_counts_tell_null_from_absent(spark):
    df = spark.createDataFrame([("x", None), ("x", 1), (None, 1)], "a string, b int")
    got = {(r["column"], r["value"]): r["n"] for r in ru.value_counts(df, ["a", "b"]).collect()}
    assert got == {("a", "x"): 2, ("a", None): 1, ("b", None): 1, ("b", "1"): 2}


def test_bounds_are_exact_below_k_and_hold_above(spark):
    df = spark.range(60000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("v"))
    big = df.groupBy("g").agg(sk.theta_bounds(sk.theta_build("v", 10), 4.0).alias("b")).select("b.*").collect()
    for r in big:
        assert r.lower < 20000 < r.upper and r.lower < r.estimate < r.upper
    small = df.filter("id < 900").agg(sk.theta_bounds(sk.theta_build("v", 12)).alias("b")).select("b.*").first()
    assert (small.estimate, small.lower, small.upper) == (900.0, 900.0, 900.0)


def test_empty_intersection_of_sampled_sketches_keeps_an_upper_bound(spark):
    df = spark.range(100000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("m"), F.col("id").alias("v"))
    sets = df.groupBy(F.lit(1).alias("k"), "m").agg(sk.theta_build("v", 10).alias("s"))
    r = sk.intersect_groups(sets, ["k"], "s", "m", 2).first()
    assert r.estimate == 0 and r.lower == 0 and r.upper > 0


def test_absent_member_means_empty(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (2, "a", 5)], "k int, m string, v int")
    sets = df.groupBy("k", "m").agg(sk.theta_build("v").alias("s"))
    got = {r.k: r.estimate for r in sk.intersect_groups(sets, ["k"], "s", "m", 2).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_lists(spark):
    listed = spark.createDataFrame([("www.a.test",), ("b.test/x",), (None,)], "url string")
    tested = spark.createDataFrame([("http://a.test/y",), (None,)], "url string")
    gap = lists.uncovered(listed, tested)
    assert [r.host_surt for r in gap.collect()] == ["test,b)"]
    ranks = spark.createDataFrame([(3, "b.test"), (9, "www.b.test")], "rank int, host string")
    more = spark.createDataFrame([("test,z)",), ("test,b)",)], "host_surt string")
    assert [tuple(r) for r in lists.untested_by_rank(ranks, gap, more).collect()] == [(3, "b.test"), (9, "b.test"), (None, "z.test")]


def test_audit(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    after = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "k int, v string")
    assert {r.k: r.change for r in quality.changed_keys(before, after, "k", ["v"]).collect()} == {2: "changed", 3: "deleted"}
    rows = quality.audit(
        quality.violations(before, "no null", F.col("v").isNull()),
        quality.duplicate_keys(before.union(before), "unique", "v"),
    ).collect()
    assert {r.rule: r.violations for r in rows} == {"no null": 1, "unique": 2}
