"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import stored


def components(links: DataFrame, name: str = "graph") -> DataFrame:
    """``node, component`` of every node in the links ``a, b``; a component is named by its least node.

    Each round hangs every node under its least neighbour, shortens these paths twice by looking
    up the parent's parent, and keeps only the links between different parents. Stars vanish in one
    round and chains shrink several times per round, so rounds grow with the logarithm of the
    longest chain. Nothing is collected; a node with very many links is combined before the shuffle.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    open_links = stored(both.where("a != b").distinct(), f"{name}-links")
    named = open_links.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        least = open_links.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        least = stored(least, f"{name}-least")
        for _ in range(2):
            up = least.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            least = least.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
        parent = stored(least, f"{name}-parent")
        named = stored(
            named.join(parent.select(F.col("a").alias("component"), "p"), "component", "left")
            .select("node", F.coalesce("p", "component").alias("component")),
            f"{name}-named",
        )
        left = parent.select("a", F.col("p").alias("pa"))
        right = parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        open_links = stored(
            open_links.join(left, "a").join(right, "b").where("pa != pb")
            .select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(),
            f"{name}-links",
        )
        if open_links.isEmpty():
            return named
