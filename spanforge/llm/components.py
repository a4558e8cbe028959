"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.storage import dropped, written

BROADCAST_NODES = 1_000_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes in an edge; component is the smallest node reachable.

    Each round takes minima by node, combined before the shuffle, and joins them back.  Minima
    are written first: up to BROADCAST_NODES of them are broadcast, so a node with very many
    edges is no group at all; beyond that both sides of the join are plain shuffles, which
    adaptive execution can split.  Rounds end when every edge leads from a leaf to the centre
    of its star.  Nulls and self-links are ignored; no edges give an empty table.
    """
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "minima")
        # In a forest of stars, a node with a smaller neighbour has no other.
        if low.where("m < u AND n > 1").isEmpty():
            dropped(low)
            break
        large = both.join(_side(low.select("u", F.least("u", "m").alias("m"))), "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(_side(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "edges")
        dropped(e, low, least)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _side(minima: DataFrame) -> DataFrame:
    return F.broadcast(minima) if minima.count() <= BROADCAST_NODES else minima

