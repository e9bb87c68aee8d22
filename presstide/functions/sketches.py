"""Mergeable approximate-distinct sketches and their estimates.

Theta sketches count exactly up to ``2**lg_k`` distinct values and support
intersection; HLL sketches are smaller when groups are large. Both store as
binary and merge by union, so rollups keep the sketch, never the estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .urlkeys import as_col

LG_K = 12
BOUND_SIGMAS = 2.0


def theta_build(c: Column | str, lg_k: int = LG_K) -> Column:
    return F.theta_sketch_agg(as_col(c), lg_k)


def theta_merge(c: Column | str, lg_k: int = LG_K) -> Column:
    return F.theta_union_agg(as_col(c), lg_k)


#: Sketches that are united one by one; more cost a pass over their list, which is dear for a few.
FEW = 6


def theta_merge_lists(c: Column | str, lg_k: int = LG_K) -> Column:
    """The union of a row's own theta sketches, given as lists of few: each list's first, then theirs."""
    lists = as_col(c)

    def union(sketches):
        rest = F.slice(sketches, F.lit(2), F.size(sketches))
        return F.aggregate(rest, F.get(sketches, F.lit(0)), lambda a, b: F.theta_union(a, b, lg_k))

    first = F.get(lists, F.lit(0))
    few = F.get(first, F.lit(0))
    chain = F.when((F.size(lists) != 1) | (F.size(first) > FEW), union(F.transform(lists, union)))
    for n in range(1, FEW + 1):
        few = F.theta_union(few, F.get(first, F.lit(n - 1)), lg_k) if n > 1 else few
        chain = chain.when(F.size(first) == n, few)
    return chain


def hll_build(c: Column | str, lg_k: int = LG_K) -> Column:
    return F.hll_sketch_agg(as_col(c), F.lit(lg_k))


def hll_merge(c: Column | str) -> Column:
    return F.hll_union_agg(as_col(c))


BUILD = {"theta": theta_build, "hll": hll_build}
MERGE = {"theta": theta_merge, "hll": hll_merge}
ESTIMATE = {"theta": F.theta_sketch_estimate, "hll": F.hll_sketch_estimate}


def theta_fraction(sketch: Column | str) -> Column:
    """Sampling fraction of a compact theta image; 1.0 while it is exact, null
    where the layout is none of those known here.

    Byte 0 holds the preamble length, byte 1 the serial version; the fraction
    is a little-endian 63-bit number whose place depends on both.
    """
    s = as_col(sketch)

    def number_at(start):
        pairs = F.regexp_extract_all(F.hex(F.substring(s, start, 8)), F.lit("(..)"), F.lit(1))
        digits = F.array_join(F.reverse(pairs), "")
        return F.conv(digits, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**63))

    preamble = F.conv(F.hex(F.substring(s, 1, 1)), 16, 10).cast("int") % 64
    version = F.conv(F.hex(F.substring(s, 2, 1)), 16, 10).cast("int")
    return (
        F.when((version == 4) & (preamble >= 2), number_at(9))
        .when((version == 3) & (preamble == 3), number_at(17))
        .when(((version == 3) & (preamble <= 2)) | ((version == 4) & (preamble == 1)), F.lit(1.0))
    )


def theta_bounds(sketch: Column | str, sigmas: float = BOUND_SIGMAS) -> Column:
    """struct(estimate, lower, upper), all doubles; the bounds meet while exact.

    Where the image does not tell its sampling fraction, the bounds are those of a
    full sketch of ``2**LG_K`` values.
    """
    s = as_col(sketch)
    est = F.theta_sketch_estimate(s).cast("double")
    frac = theta_fraction(s)
    # A sampled sketch that retained nothing still allows a few values.
    spread = F.coalesce(sigmas * F.sqrt(F.greatest(est, 1 / frac) * (1 - frac) / frac), sigmas * est / (2**LG_K - 1) ** 0.5)
    return F.struct(
        est.alias("estimate"),
        F.greatest(est - spread, F.lit(0.0)).alias("lower"),
        (est + spread).alias("upper"),
    )


def intersect_groups(
    df: DataFrame, keys: list[str], sketch_col: str, member_col: str, n_members: int
) -> DataFrame:
    """Intersect one sketch per member within each key group.

    A member absent from a group counts as an empty set, so the group's
    estimate is zero. Adds estimate, lower and upper.
    """
    return (
        df.filter(F.col(sketch_col).isNotNull())
        .groupBy(*keys)
        .agg(
            F.theta_intersection_agg(sketch_col).alias("_sk"),
            F.count_distinct(member_col).alias("_n"),
        )
        .withColumn("_b", theta_bounds("_sk"))
        .select(
            *keys,
            *[
                F.when(F.col("_n") == n_members, F.col(f"_b.{c}")).otherwise(F.lit(0.0)).alias(c)
                for c in ("estimate", "lower", "upper")
            ],
        )
    )
