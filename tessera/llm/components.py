"""Connected components of an edge table, without gathering edges on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    Large-star and small-star rounds: each round hangs every node's larger neighbours on
    its smallest neighbour, then its smaller ones, until only stars are left, in O(log n)
    rounds as a rule. A node's smallest neighbour is an aggregate with partial sums, and the joins
    are plain equi-joins that AQE can split, so that one node may have most of all edges.
    Each round is checkpointed in the shared folder. Null ends and loops are left out.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = checkpointed(e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    seen = _mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = _star(both, large=True)
        e = checkpointed(_star(e, large=False))
        now = _mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _star(e: DataFrame, large: bool) -> DataFrame:
    """e: every neighbour v of u (large), or every smaller neighbour v of u."""
    least = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = e.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _mark(e: DataFrame) -> tuple:
    """Count and checksums: equal when no edge has changed."""
    row = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(7)))).first()
    return tuple(row)
