"""Approximate-distinct rollups that keep mergeable sketches.

A rollup is a set of key expressions and a set of measured expressions. The
stored form (:func:`build`) holds one sketch per measure plus a row count, so
two rollups over disjoint batches merge (:func:`merge`) into the rollup of the
whole; :func:`finalize` turns sketches into numbers. Sketches are partially
aggregated before the shuffle, so a key that holds a third of all rows sends
one small binary per task, not its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sketches as sk
from ..functions import urlkeys as uk

N_ROWS = "n_rows"


def url_measures(url: Column | str = "url", with_host: bool = False) -> dict[str, Column]:
    """Distinct URLs at up to four key granularities."""
    out = {
        "url": uk.as_col(url),
        "hostpathquery": uk.url_hostpathquery_surt(url),
        "hostpath": uk.url_hostpath_surt(url),
    }
    if with_host:
        out["host"] = uk.url_host_surt(url)
    return out


@dataclass(frozen=True)
class RollupSpec:
    keys: Mapping[str, Column]
    measures: Mapping[str, Column]
    where: Column | None = None
    kind: str = "theta"
    lg_k: int = field(default=sk.LG_K)

    def __post_init__(self):
        twice = set(self.keys) & set(self.measures)
        if twice:
            raise ValueError(f"both key and measure: {sorted(twice)}")


def _projected(df: DataFrame, spec: RollupSpec) -> DataFrame:
    if spec.where is not None:
        df = df.filter(spec.where)
    columns = [c.alias(k) for k, c in spec.keys.items()]
    columns += [c.alias(f"_m_{m}") for m, c in spec.measures.items()]
    return df.select(*columns)


def build(df: DataFrame, spec: RollupSpec) -> DataFrame:
    """Stored form: keys, one sketch per measure, and the row count."""
    make = sk.BUILD[spec.kind]
    return (
        _projected(df, spec)
        .groupBy(*spec.keys)
        .agg(
            *[make(F.col(f"_m_{m}"), spec.lg_k).alias(m) for m in spec.measures],
            F.count(F.lit(1)).alias(N_ROWS),
        )
    )


def combine(parts: DataFrame, spec: RollupSpec) -> DataFrame:
    """One stored rollup out of the rows of several."""
    union = sk.MERGE[spec.kind]
    return parts.groupBy(*spec.keys).agg(
        *[union(m).alias(m) for m in spec.measures], F.sum(N_ROWS).alias(N_ROWS)
    )


def merge(old: DataFrame, new: DataFrame, spec: RollupSpec) -> DataFrame:
    """Rollup of the union of two disjoint inputs, from their stored forms."""
    return combine(old.unionByName(new), spec)


def finalize(stored: DataFrame, spec: RollupSpec, with_rows: bool = False) -> DataFrame:
    """Numbers from a stored rollup; a measure that was always null counts 0."""
    estimate = sk.ESTIMATE[spec.kind]
    columns = [F.col(k) for k in spec.keys]
    columns += [F.coalesce(estimate(m), F.lit(0)).cast("bigint").alias(m) for m in spec.measures]
    if with_rows:
        columns.append(F.col(N_ROWS))
    return stored.select(*columns)


def rollup(df: DataFrame, spec: RollupSpec, with_rows: bool = False) -> DataFrame:
    return finalize(build(df, spec), spec, with_rows)


def rollup_exact(df: DataFrame, spec: RollupSpec) -> DataFrame:
    """The same table by exact distinct counts; costs a shuffle of every value."""
    return (
        _projected(df, spec)
        .groupBy(*spec.keys)
        .agg(*[F.count_distinct(F.col(f"_m_{m}")).cast("bigint").alias(m) for m in spec.measures])
    )


def rollup_checked(df: DataFrame, spec: RollupSpec, tolerance: float = 0.05) -> DataFrame:
    """Exact counts beside ``<measure>_ok``: the sketch is within ``tolerance``."""
    estimate, make = sk.ESTIMATE[spec.kind], sk.BUILD[spec.kind]
    aggs = []
    for m in spec.measures:
        aggs.append(F.count_distinct(F.col(f"_m_{m}")).cast("bigint").alias(m))
        aggs.append(make(F.col(f"_m_{m}"), spec.lg_k).alias(f"_s_{m}"))
    out = _projected(df, spec).groupBy(*spec.keys).agg(*aggs)
    ok = [
        (F.abs(F.coalesce(estimate(f"_s_{m}"), F.lit(0)) - F.col(m)) <= F.col(m) * tolerance + 1).alias(f"{m}_ok")
        for m in spec.measures
    ]
    return out.select(*spec.keys, *spec.measures, *ok)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row counts of several columns, one pass: (column, value, n).

    Grouping sets pre-aggregate all columns in the same scan. ``grouping``
    tells a null value from a column that is not in the set.
    """
    sets = [[F.col(c)] for c in columns]
    counted = df.groupingSets(sets, *[F.col(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"_g_{c}") for c in columns]
    )
    name, value = None, None
    for c in columns:
        here = F.col(f"_g_{c}") == 0
        text = F.col(c).cast("string")
        name = F.when(here, F.lit(c)) if name is None else name.when(here, F.lit(c))
        value = F.when(here, text) if value is None else value.when(here, text)
    return counted.select(name.alias("column"), value.alias("value"), "n")


def sum_of_hosts(hoststats: DataFrame, language: Column, measures: Sequence[str]) -> DataFrame:
    """Second-level sums of a finished host-by-language table, per language."""
    return hoststats.groupBy(language.alias("language_iso639")).agg(
        *[F.sum(m).cast("bigint").alias(m) for m in measures], F.count("host").alias("host")
    )
