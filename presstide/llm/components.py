"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import persist_table


def _with_least(links: DataFrame, node: str, other: str) -> DataFrame:
    """Each link with the least neighbour of its node, the node itself included.

    The minima are stored before they are joined back, so that a node with very many
    links is split among tasks.
    """
    least = links.groupBy(F.col(node).alias("n")).agg(F.min(other).alias("m"))
    least = persist_table(least.select("n", F.least("n", "m").alias("m")), "least")
    return links.join(least, F.col(node) == F.col("n")).drop("n")


def _flat(stars: DataFrame) -> bool:
    """Whether every node is linked to one other, which is linked to none."""
    ends = stars.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out")))).alias("e"))
    outs = ends.groupBy("e.node").agg(F.sum("e.out").alias("out"), F.min("e.out").alias("into"))
    return outs.filter("out > 1 or out = 1 and into = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node but the least of each component.

    ``links``: a, b. Each round every node's larger neighbours, then its smaller ones,
    are linked to its least neighbour, until all links are flat stars; the rounds
    needed grow with the logarithm of the longest path, and the links never become
    more. Links of a node with itself and nulls say nothing.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    stars = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = persist_table(stars, "links")
    while not _flat(stars):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, "a", "b").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = persist_table(large.filter("a <> b"), "large")
        small = _with_least(large, "a", "b")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s"))
        stars = persist_table(small.select("s.a", "s.b").filter("a <> b").distinct(), "small")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
