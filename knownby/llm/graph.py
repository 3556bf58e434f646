"""Connected components of an undirected graph given as rows of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownby.session import materialize, tasks_for

TASK_EDGES = 250_000


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node with a link. links: a, b of one ordered type.

    Alternating large-star and small-star steps: each points the neighbours of a node
    at the smallest of them, in turn those above and those below the node, until only
    stars remain: every node is then either a centre or the leaf of one edge, which is
    looked up before each round, so links that are stars already cost none. Minima are
    reduced before the shuffle, so a node with a third of all links is no hot spot;
    every step is written to the shared folder, in files that follow the number of
    edges, not that of the shuffle's partitions.
    """
    spark = links.sparkSession
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b"))
    while True:
        ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("leaf")).union(edges.select("b", F.lit(1)))
        nodes = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.count("*").alias("degree"))
        moving = F.col("leaf") > F.when(F.col("degree") > 1, 0).otherwise(1)
        open_nodes, degrees = nodes.agg(F.count(F.when(moving, 1)), F.sum("degree")).first()
        if not open_nodes:
            break
        tasks = tasks_for(spark, degrees // 2, TASK_EDGES)
        both = edges.union(edges.select("b", "a"))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialize(edges.join(smallest, "a").select(F.col("m").alias("a"), "b"), tasks)
        # Each node is now seen from above: b has smaller neighbours a.
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lowest, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).where("x < y").union(lowest.select("m", "b"))
        edges = materialize(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), tasks)
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
