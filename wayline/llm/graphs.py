"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum (partial sums before the shuffle) and a join, so
a node with very many edges is spread over tasks; nothing goes to the driver but
a count and a checksum. The number of rounds follows the logarithm of the
longest path, not the size of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm import frames


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (large: all, else the smaller ones) linked to the least of them and itself."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    around = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); the component is its least node."""
    now, seen = frames.written(edges.select("u", "v").where("u <> v").distinct()), None
    while True:
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if (n, total) == seen or not n:
            break
        seen = n, total
        after = frames.written(_stars(_stars(now, True), False))
        frames.dropped(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
