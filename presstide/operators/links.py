"""Link edges between hosts and pages, and what they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urlkeys as uk
from ..session import persist_table
from .captures import best
from .rollups import RollupSpec, url_measures

DEFAULT_RANK = 1_000_000


def resolve_href(url: Column | str, href: Column | str) -> Column:
    """Absolute form of a link found on page ``url``."""
    u, h = uk.as_col(url), uk.as_col(href)
    scheme = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*:", 0)
    site = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", 0)
    bare = F.regexp_extract(u, r"^[^?#]*", 0)
    folder = F.when(F.length(bare) > F.length(site), F.regexp_extract(bare, r"^(?:.*/)", 0)).otherwise(
        F.concat(site, F.lit("/"))
    )
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, h))
        .when(h.startswith("/"), F.concat(site, h))
        .when(h.startswith("?"), F.concat(bare, h))
        .when(h.startswith("#") | (h == ""), F.concat(F.regexp_extract(u, r"^[^#]*", 0), h))
        .otherwise(F.concat(folder, h))
    )


def edges(captures: DataFrame, links: str = "links.all") -> DataFrame:
    """One row per link: the page's url and the link's absolute address."""
    return captures.select(
        "id", "url", F.explode(best("doc", links)).alias("_link")
    ).select("id", "url", resolve_href("url", F.col("_link.href")).alias("href"))


def host_edge_spec(surt: bool = True) -> RollupSpec:
    """Distinct source pages per host pair; SURT or plain host names."""
    host = uk.url_host_surt if surt else uk.url_host
    measures = {f"src_{name}": col for name, col in url_measures("url").items()}
    return RollupSpec(keys={"src": host("url"), "dest": host("href")}, measures=measures)


def page_edges(link_rows: DataFrame) -> DataFrame:
    """Link counts between page keys."""
    return link_rows.groupBy(
        uk.url_hostpath_surt("url").alias("src"), uk.url_hostpath_surt("href").alias("dest")
    ).agg(F.count(F.lit(1)).alias("n"))


def backlinks(link_rows: DataFrame, dest_host: str) -> DataFrame:
    """Pages linking to a host, each once per linked page."""
    key = uk.url_host_surt(F.lit(dest_host))
    return (
        link_rows.filter(uk.url_host_surt("href") == key)
        .select(
            uk.url_hostpath_surt("href").alias("dest"), uk.url_hostpath_surt("url").alias("src")
        )
        .distinct()
    )


def best_rank(ranks: DataFrame) -> DataFrame:
    """One rank per host key, the best where lists name a host twice, stored."""
    best = ranks.groupBy(uk.url_host_surt("host").alias("src")).agg(F.min("rank").alias("rank"))
    return persist_table(best, "ranks")


def weighted_inlinks(edge_rollup: DataFrame, ranks: DataFrame, default_rank: int = DEFAULT_RANK) -> DataFrame:
    """Sums of 1/rank-weighted sources per destination host.

    The rank list is unique per host, so the edge table keeps its size. Spark
    broadcasts it when its measured size allows; else a host that links a
    third of all edges has its rows split.
    """
    joined = edge_rollup.join(best_rank(ranks), "src", "left")
    weight = F.coalesce("rank", F.lit(default_rank)).cast("double")
    sums = [F.sum(F.col(m) / weight).alias(m) for m in ("src_url", "src_hostpathquery", "src_hostpath")]
    return joined.groupBy("dest").agg(*sums, F.sum(F.lit(1.0) / weight).alias("src_host"))
