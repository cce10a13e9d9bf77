"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

MAX_ROUNDS = 60


def _digest(e: DataFrame) -> tuple:
    """Number of edges and 128 bits of a hash that ignores their order."""
    h = [F.bit_xor(F.xxhash64("u", "v", F.lit(k))) for k in (1, 2)]
    return tuple(e.agg(F.count("*"), *h).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component`` (its smallest id) of every id in ``edges``.

    A large star links every larger neighbour of a node to the smallest one
    around it, a small star does the same for the smaller ones; after a few
    rounds every node hangs on the smallest id of its component. No group is
    gathered: both are a minimum per node and a join.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = settle(e, "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    seen = _digest(e)
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        e, before, seen = new, seen, _digest(new)
        if before == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
