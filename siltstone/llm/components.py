"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two grouped minima with partial aggregation; its edges are written to the shared
scratch folder.  No edge or label reaches the driver, only whether a round was the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _settled(edges: DataFrame) -> bool:
    """Whether each node hangs on one root, and no root hangs on anything."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up + root > 1").isEmpty()


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star over edges (u, v) with v < u; returns edges of that kind.

    The minima of the large-star are written first: the join is then between two plain shuffles, and Spark
    splits the partition of a hub.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "cc-low")
    large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return materialize(small.distinct(), "cc-edges")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of each node that has an edge in edges (u, v), component being the smallest node.

    Loops and rows with a null end are ignored; repeated edges count once.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u is not null and v is not null and u <> v").distinct(), "cc-edges")
    for _ in range(most_rounds):
        if _settled(edges):
            break
        edges = _round(edges)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
