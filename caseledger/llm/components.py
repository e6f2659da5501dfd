"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseledger.operators.skew import join_back
from caseledger.storage import reliable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the smallest node of each node's component.

    Alternates two steps on the edge table until nothing changes: every larger
    neighbour of a node is linked to the node's smallest neighbour, then every smaller
    one. Each step is a grouped minimum joined back, so a node with very many
    neighbours is never gathered in one task. Nodes without an edge are not listed;
    a self-loop lists its node.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    links = reliable(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (
            join_back(both, low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = large.union(links.filter("u = v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_back(large, low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))
        )
        after = reliable(small.distinct())
        state = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if after.select(state).first() == links.select(state).first():
            break
        links = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
