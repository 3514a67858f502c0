"""Connected components of an edge list by alternating large-star and small-star steps.

Every step is a grouped minimum joined back to the edges, so a hub with a third
of all edges is pre-aggregated and its join side can be split; the rounds needed
grow with the logarithm of the longest path. Nothing is gathered on the driver
but one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import cut

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node of an edge; component is the smallest node reachable.

    Edges are undirected and may repeat; loops and edges with a null end are left out, so a node with
    no other edge is not in the result. Nodes are of any one ordered type.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    e = cut(e.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        e = cut(_small_star(_large_star(e)))
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (now.n, now.s) == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = (now.n, now.s)
    raise RuntimeError("components did not settle")
