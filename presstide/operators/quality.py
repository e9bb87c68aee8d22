"""Constraint checks over whole tables: (rule, violations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def violations(df: DataFrame, rule: str, bad: Column) -> DataFrame:
    return df.agg(F.count_if(bad).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def missing(df: DataFrame, rule: str, *columns: str) -> DataFrame:
    """Rows in which any of these columns is null."""
    return violations(df, rule, reduce(Column.__or__, [F.col(c).isNull() for c in columns]))


def duplicate_keys(df: DataFrame, rule: str, *keys: str) -> DataFrame:
    """Rows beyond the first of each key; keys with a null part never collide."""
    return (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations"))
        .select(F.lit(rule).alias("rule"), "violations")
    )


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key the parent, which has it once, lacks."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def changed_keys(before: DataFrame, after: DataFrame, key: str, guarded: list[str]) -> DataFrame:
    """Rows of ``before`` that were deleted, or whose guarded columns changed."""
    old = before.select(key, F.xxhash64(*guarded).alias("_old"))
    new = after.select(key, F.xxhash64(*guarded).alias("_new"))
    return (
        old.join(new, key, "left")
        .select(key, F.when(F.col("_new").isNull(), "deleted").when(F.col("_new") != F.col("_old"), "changed").alias("change"))
        .filter("change IS NOT NULL")
    )


def audit(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
