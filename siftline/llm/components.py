"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.staging import staged, unstage


def _hooked(pairs: DataFrame, within: DataFrame) -> DataFrame:
    """Every (u, v) of ``pairs`` with the least of u and its neighbours in ``within``."""
    least = within.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return pairs.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node of ``edges`` can reach.

    Nodes without edges don't appear; self-loops and repeated edges change nothing. Every step is a grouping
    with partial aggregation and a join, written to the shared folder; the number of steps is logarithmic.
    """
    x, y = F.col(a), F.col(b)
    now = staged(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hooked(both, both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        low = large.where("u > v")
        small = _hooked(low, low)
        last = now
        now = staged(
            small.select(F.col("v").alias("u"), F.col("least").alias("v"))
            .union(small.select("u", F.col("least").alias("v")))
            .where("u > v")
            .distinct()
        )
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        unstage(last)
        if state == before:
            break
        before = state
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(now.select("v", "v").distinct())
