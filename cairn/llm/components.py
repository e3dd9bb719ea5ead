"""Connected components of a link table, as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node that occurs in ``links`` (columns a, b); root is the least node reachable.

    Large-star and small-star passes (Kiveris et al., 2014): each is an aggregation of a node's least
    neighbour, combined before the shuffle, and a join with it; no neighbour list is ever gathered, but the links of one
    node, pairs of numbers, pass through one task of the join, one after another. The table of links is cut by a checkpoint each round. Rows with a
    null end are no links; a row that links a node with itself only lists the node.
    """
    links = links.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    alone = links.where("a = b").select(F.col("a").alias("node")).distinct()
    edges, before = links.where("a <> b"), None
    for _ in range(max_rounds):
        edges = cut(_small_star(_large_star(edges)))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError("components: no fixed point within max_rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return (
        stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")))
        .union(alone.select("node", F.col("node").alias("root")))
        .groupBy("node")
        .agg(F.min("root").alias("root"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
