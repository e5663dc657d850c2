"""Connected components of a graph whose nodes are labels of pixel regions, by contraction.

A round points every node at the first of itself and its neighbours in an order that a hash gives, follows such pointers to
their pointers, and puts the pointed-at nodes in the edges' places. Nodes that are not first among their neighbours go, at
least half of them, and as the order is one of chance no long chain descends: rounds grow with the logarithm of the graph.
Rounds are written to the shared folder; each is a few equi-joins, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.layers import written_table

#: No graph needs so many rounds.
MOST_ROUNDS = 64


def roots(edges: DataFrame) -> DataFrame:
    """img_id, node, root (the least node of its component) for every node of edges (img_id, u, v)."""
    left = written_table(edges.select("img_id", "u", "v").where("u <> v").distinct(), "label-edges")
    both = lambda e: e.select("img_id", "u", "v").unionByName(e.select("img_id", F.col("v").alias("u"), F.col("u").alias("v")))
    known = written_table(both(left).select("img_id", F.col("u").alias("node"), F.col("u").alias("root")).distinct(), "label-roots")
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            least = known.groupBy("img_id", "root").agg(F.min("node").alias("least"))
            return known.join(least, ["img_id", "root"]).select("img_id", "node", F.col("least").alias("root"))
        placed = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
        down = both(left).groupBy("img_id", F.col("u").alias("at")).agg(F.least(F.first(placed("u")), F.min(placed("v")))["x"].alias("to"))
        next_ = down.select("img_id", F.col("at").alias("to"), F.col("to").alias("further"))
        down = written_table(down.join(next_, ["img_id", "to"]).select("img_id", "at", F.col("further").alias("to")), "label-down")
        known = written_table(known.join(down, (known["img_id"] == down["img_id"]) & (known["root"] == down["at"]), "left").select(known["img_id"], "node", F.coalesce("to", "root").alias("root")), "label-roots")
        moved = left
        for end in ("u", "v"):
            moved = moved.join(down.select("img_id", F.col("at").alias(end), F.col("to").alias(f"new_{end}")), ["img_id", end])
        left = written_table(moved.select("img_id", F.least("new_u", "new_v").alias("u"), F.greatest("new_u", "new_v").alias("v")).where("u <> v").distinct(), "label-edges")
    raise RuntimeError("the labels did not settle")
