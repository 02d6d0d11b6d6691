"""Connected components of a distributed edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specaudit.llm.common import discard, materialize


def _smallest(pairs: DataFrame) -> DataFrame:
    """For each node ``u`` the least of itself and its neighbours; partial minima leave each task first."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` (least node reachable) of every node with an edge to another.

    A round links each node's larger neighbours to its least neighbour (large star), then
    its smaller ones (small star); O(log n) rounds in practice, each two joins on a node
    against one row a node, so AQE can split a hub.  Rounds are written to the shared folder.
    Edges of a node to itself and null ends are ignored; repeated edges count once.
    """
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "components")
    mark = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node's least neighbour keeps its own link through the node itself
        large = large.union(_smallest(both).where("m < u").select("u", F.col("m").alias("v"))).where("u > v").distinct()
        small = large.join(_smallest(large), "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        after = materialize(after, "components")
        discard(now)
        now = after
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            out = materialize(out, "components")
            discard(now)
            return out
        mark = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
