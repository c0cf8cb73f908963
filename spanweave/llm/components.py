"""Connected components of an edge table, distributed.

Alternating star contraction: a large-star step hangs every larger neighbour
of a node on the smallest node it sees, a small-star step does so for the
smaller ones.  Both are one aggregation (combined before the shuffle) and one
join, so a node with very many neighbours is no problem; tables are written
to the shared folder between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v, distinct.  The edges after one step, u > v."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node of an edge; root is the least node reachable.

    ``edges`` has two columns u and v of one orderable type without nulls; the
    direction, repeats and loops of edges do not matter.
    """
    edges = edges.select("u", "v")
    flat = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    flat = materialise(flat, "star")
    seen = None
    for _ in range(most):
        flat = materialise(_star(_star(flat, True).where("u > v").distinct(), False).where("u > v").distinct(), "star")
        now = flat.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return flat.select(F.col("u").alias("node"), F.col("v").alias("root")).union(flat.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {most} rounds")
