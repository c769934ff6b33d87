"""Connected components of a graph given as links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _nearest(links: DataFrame) -> DataFrame:
    """For each node the smallest node among itself and its neighbours."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for the nodes of ``links(a, b)``, which are longs.

    Each round hangs larger neighbours, then smaller ones, on a node's smallest neighbour, and ends when a round changes
    nothing; that takes about the logarithm of the longest path. A round only sums up per node and joins per link, so a
    node with very many links is no large group. Self-links are allowed; a node with only those is a component.
    """
    alone = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    alone = cut(alone)
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        near = _nearest(now)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(near, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = cut(large.where("a <> b"))
        down = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(down, "a").select("a", "b", "least")
        small = small.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(small.select("a", F.col("least").alias("b")))
        now = cut(small.where("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return alone.join(now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")), "node", "left").select(
        "node", F.coalesce("least", "node").alias("component")
    )
