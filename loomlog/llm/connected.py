"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_dealt, materialize


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): every node of the edges (u, v) with the smallest node it reaches. Nodes are whole numbers.

    Each round replaces a node's links by links to its smallest neighbour, so a long path shortens by half or more and
    the number of rounds grows with the logarithm of the component's size. Rounds are written to the shared folder. The
    links of a node with very many are dealt over tasks.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    mark = _mark(now)
    for _ in range(most_rounds if mark[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("links"))
        hubs = hot_keys(least, "u", "links", 2 * mark[0], least=100_000)
        large = join_dealt(both, least.drop("links"), "u", hubs, ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("links"))
        hubs = hot_keys(least, "u", "links", 2 * mark[0], least=100_000)
        small = join_dealt(large, least.drop("links"), "u", hubs, ["v"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        if mark[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
