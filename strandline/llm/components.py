"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its least node) for each node of edges(a, b); by alternating large and small stars.

    A round keeps or lowers the number of edges, each step is a grouped minimum and an equi-join, and the
    lineage is cut each round. Self-links and links with a null end are left out, so their nodes may be missing.
    """
    links = cut(_ordered(edges))
    before = None
    for _ in range(rounds):
        large = _star(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), large=True)
        links = cut(_ordered(_star(_ordered(large), large=False)))
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(links.select("b", "b").distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    """a > b, each link once."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """large: each node links its larger neighbours to the least of itself and its neighbours. Small: links(a > b) of
    a node a to smaller ones become links of these, and of a, to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        joined = links.where("b > a").join(least.select("a", F.least("a", "m").alias("m")), "a")
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    joined = links.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
