"""Connected components of an edge table by alternating large and small stars.

A round joins the edges with the least neighbour of each node, both sides shuffled, so a node
with very many edges is split by adaptive execution, and deals what it gets by the larger node, which has
few edges then. Rounds are written to the shared folder, and stop when every edge hangs
on the centre of a star. Rounds grow with the logarithm of the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, partitions


def _least(edges: DataFrame) -> DataFrame:
    """u, v, m: each edge from both ends with the least of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "u")


def _settled(edges: DataFrame) -> bool:
    """Whether each node is the centre of a star or an end with one edge, so that components can be read off."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")), F.struct(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("high")))).alias("e"))
    return ends.groupBy("e.x").agg(F.sum("e.low").alias("low"), F.max("e.high").alias("high")).where("low + high > 1").isEmpty()


def nodes_of(stars: DataFrame) -> DataFrame:
    """node, component of disjoint stars (u, v) with their centres at v."""
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its least node) for every node of edges (u, v), two bigint columns."""
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            return nodes_of(now)
        # Large star: every neighbour above u hangs on the least; small star: u and those below it do.
        large = _least(now).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition(partitions(edges.sparkSession), "u")
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        both = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        before, now = now, materialise(small.select(F.explode(both).alias("e")).select("e.*").where("u <> v").distinct(), "stars")
        discard(before)
    raise RuntimeError("the components did not settle")
