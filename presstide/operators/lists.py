"""Curated host lists: coverage against tested pages, and what to look at next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as sc
from ..functions import urlkeys as uk


def host_keys(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct host keys of a table."""
    return df.select(uk.url_host_surt(url_col).alias("host_surt")).distinct()


def uncovered(listed: DataFrame, tested: DataFrame, url_col: str = "url") -> DataFrame:
    """Host keys of a list that no tested page has."""
    mine = host_keys(listed, url_col).filter("host_surt IS NOT NULL")
    return mine.join(host_keys(tested), "host_surt", "left_anti")


def not_banned(priority: Column | str = "priority") -> Column:
    """True unless a curated host is banned; no priority means not banned."""
    return F.coalesce(uk.as_col(priority), F.lit("")) != "ban"


def hosts_to_check(hoststats: DataFrame, tested_hosts: DataFrame) -> DataFrame:
    """Untested hosts, many pages with few publication times first."""
    return (
        hoststats.join(tested_hosts.select(F.col("host_surt").alias("host")), "host", "left_anti")
        .select(
            uk.host_unsurt("host").alias("host"),
            sc.language_iso639("language").alias("language_iso639"),
            (F.pow(F.col("hostpath").cast("double"), F.lit(1.5)) / (1 + F.col("timestamp_published"))).alias("score"),
            "timestamp_published",
            "hostpath",
        )
        .orderBy(F.col("score").desc_nulls_first(), F.col("host").asc_nulls_last())
    )


def untested_by_rank(ranks: DataFrame, *untested: DataFrame) -> DataFrame:
    """Union of untested host lists with their rank, unranked ones last."""
    hosts = untested[0].select("host_surt")
    for more in untested[1:]:
        hosts = hosts.union(more.select("host_surt"))
    ranked = ranks.select("rank", uk.url_host_surt("host").alias("host_surt"))
    return (
        ranked.join(hosts.distinct(), "host_surt", "right")
        .select("rank", uk.host_unsurt("host_surt").alias("host"))
        .orderBy(F.col("rank").asc_nulls_last(), "host")
    )


def top_hosts(rollup: DataFrame, suffix: str, by: str = "url", k: int = 20) -> DataFrame:
    """Host panel: the ``k`` largest rows of hosts ending in ``suffix``."""
    rest = [F.col(c).asc_nulls_last() for c in rollup.columns if c != by]
    return rollup.filter(F.col("host").endswith(suffix)).orderBy(F.col(by).desc_nulls_first(), *rest).limit(k)
