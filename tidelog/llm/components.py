"""Connected components of a link table, by alternating large-star and small-star rounds.

No node list, link list or component is ever on the driver: a round is two
aggregations and two joins, each written to the checkpoint folder. Joins have
shuffled inputs on both sides, so adaptive execution splits a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import drop, stash


def _least_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least node of the neighbourhood."""
    both = links.union(links.select("v", "u"))
    least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the least of them."""
    least = _least_neighbour(links)
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the least node of each linked node's component.

    Links may repeat and point either way; self links and nulls are ignored.
    Nodes without links do not appear. An empty table gives an empty table.
    """
    a, b = links.columns
    links = stash(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        last, links = links, stash(_small_star(_large_star(links)))
        drop(last)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
