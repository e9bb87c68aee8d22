"""Term and total series over time, gap-filled on a calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as sc
from ..functions import sketches as sk

EPSILON = 1e-10
MAX_CALENDAR = 100_000
#: Bits of a subset number that one explode counts through.
SUBSET_BITS = 15
SERIES = ("estimate", "lower", "upper")


def calendar(spark: SparkSession, lo: str, hi: str, unit: str = "month") -> DataFrame:
    """Times from ``lo`` to ``hi``, both included, one per unit.

    Its length follows from the arguments, never from data, and is checked;
    a series filled onto it is as short, and only such series are broadcast.
    """
    days = (F.lit(hi).cast("date"), F.lit(lo).cast("date"))
    n = F.datediff(*days) if unit == "day" else F.months_between(*days)
    step = {"month": F.expr("INTERVAL 1 MONTH"), "day": F.expr("INTERVAL 1 DAY")}[unit]
    times = F.sequence(F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp"), step)
    bounded = F.when(n < MAX_CALENDAR, times).otherwise(F.raise_error(F.lit("calendar too long")))
    return spark.range(1, numPartitions=1).select(F.explode(bounded).alias("time"))


def fill(series: DataFrame, cal: DataFrame, values: Sequence[str]) -> DataFrame:
    """Every calendar time once, absent values as 0."""
    return cal.join(series, "time", "left").select(
        "time", *[F.coalesce(v, F.lit(0)).alias(v) for v in values]
    )


def totals(rollup: DataFrame, language: str, lo: str, hi: str) -> DataFrame:
    """Documents per month of a language, ``lo <= time < hi``."""
    return rollup.filter(
        (F.col("language") == language) & sc.time_in("timestamp_published_month", lo, hi)
    ).select(F.col("timestamp_published_month").alias("time"), F.col("hostpath_surt").alias("total"))


def term_sketches(rollup: DataFrame, terms: Sequence[str], language: str, lo: str, hi: str) -> DataFrame:
    """Rows of the sketch rollup for these terms; the filters reach its files."""
    return rollup.filter(
        F.col("alltext").isin(list(terms))
        & (F.col("language") == language)
        & sc.time_in("timestamp_published_month", lo, hi)
    ).select(F.col("timestamp_published_month").alias("time"), "alltext", "hostpath_surt")


def cooccurrence(rollup: DataFrame, terms: Sequence[str], language: str, lo: str, hi: str) -> DataFrame:
    """Documents holding all terms per month: estimate with bounds."""
    terms = list(dict.fromkeys(terms))
    rows = term_sketches(rollup, terms, language, lo, hi)
    return sk.intersect_groups(rows, ["time"], "hostpath_surt", "alltext", len(terms))


def trend(
    total_rollup: DataFrame,
    term_rollup: DataFrame,
    terms: Sequence[str],
    language: str,
    lo: str,
    hi: str,
    normalize: str | Sequence[str] = "none",
) -> DataFrame:
    """(time, total, estimate, lower, upper) over the months of ``lo``..``hi``.

    ``normalize`` is ``none``, ``total``, or the terms of another query whose
    series divides this one.
    """
    cal = calendar(total_rollup.sparkSession, lo, hi)
    base = fill(totals(total_rollup, language, lo, hi), cal, ["total"])
    if terms:
        series = fill(cooccurrence(term_rollup, terms, language, lo, hi), cal, SERIES)
        out = base.join(F.broadcast(series), "time")
    else:
        out = base.select("time", "total", *[F.col("total").cast("double").alias(c) for c in SERIES])
    if normalize == "none":
        return out
    if normalize == "total":
        return out.select("time", "total", *[(F.col(c) / (F.col("total") + EPSILON)).alias(c) for c in SERIES])
    other = fill(cooccurrence(term_rollup, list(normalize), language, lo, hi), cal, SERIES)
    other = other.select("time", *[F.col(c).alias(f"_{c}") for c in SERIES])
    return out.join(F.broadcast(other), "time").select(
        "time", "total", *[(F.col(c) / (F.col(f"_{c}") + EPSILON)).alias(c) for c in SERIES]
    )


def ratio_series(
    total_rollup: DataFrame, term_rollup: DataFrame, terms: Sequence[str], language: str, lo: str, hi: str
) -> DataFrame:
    """One column ``y0..`` per term: its documents over all documents per month.

    All terms come from one filtered read and one pivot.
    """
    cal = calendar(total_rollup.sparkSession, lo, hi)
    closed = sc.time_in("timestamp_published_month", lo, hi, closed=True) & (F.col("language") == language)
    total = total_rollup.filter(closed).select(
        F.col("timestamp_published_month").alias("time"), F.col("hostpath_surt").alias("_total")
    )
    wide = (
        term_rollup.filter(closed & F.col("alltext").isin(list(terms)))
        .groupBy(F.col("timestamp_published_month").alias("time"))
        .pivot("alltext", list(terms))
        .agg(F.sum("hostpath_surt"))
    )
    ratios = [
        F.coalesce(F.col(f"`{t}`").cast("double") / F.col("_total"), F.lit(0.0)).alias(f"y{i}")
        for i, t in enumerate(terms)
    ]
    joined = cal.join(total, "time", "left").join(wide, "time", "left")
    return joined.select(sc.epoch("time").alias("x"), *ratios).orderBy("x")


def month_window(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """Selected range widened to whole months: first of ``lo``'s, first after ``hi``'s."""
    return df.withColumns(
        {
            "time_lo": sc.month_of(lo),
            "time_hi": F.add_months(sc.month_of(hi), 1).cast("timestamp"),
        }
    )


def term_subsets(query_terms: DataFrame) -> DataFrame:
    """Every proper non-empty subset of a query's terms, as denominators.

    ``query_terms`` has query_id and ``terms``, an array; phrases are quoted. A
    query of n terms has 2**n - 2 subsets, each a row of its own: their numbers
    are exploded high bits first, so no array grows with them.
    """
    n = F.size("terms")
    quoted = F.transform("terms", lambda t: F.when(t.contains(" "), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t))

    def numbers(bits):
        return F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), bits).cast("long") - 1)

    low = F.least(n, F.lit(SUBSET_BITS))
    high = query_terms.filter(n > 1).select("query_id", quoted.alias("_t"), low.alias("_low"), F.explode(numbers(n - low)).alias("_high"))
    masks = high.select("query_id", "_t", (F.col("_high") * 2**SUBSET_BITS).alias("_base"), F.explode(numbers(F.col("_low"))).alias("_rest"))
    masks = masks.withColumn("_mask", F.col("_base") + F.col("_rest"))
    masks = masks.filter((F.col("_mask") > 0) & (F.col("_mask") < F.pow(F.lit(2), F.size("_t")).cast("long") - 1))
    picked = F.filter("_t", lambda t, i: F.floor(F.col("_mask") / F.pow(F.lit(2), i)) % 2 == 1)
    return masks.select("query_id", F.size(picked).alias("n_terms"), F.array_join(picked, " ").alias("subset"))
