"""Connected components by alternating large and small stars, all joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.llm.common import staged


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Every neighbour of ``u`` (itself included) now points at the least of them."""
    if both_ways:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = edges.join(least, "u")
    moved = met.filter("v > u" if both_ways else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not both_ways:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``(node, component)`` for every node that has an edge in ``(u, v)``; the component is
    the least node that can be reached. Null ends, loops and repeated edges change nothing.
    A hub is an ordinary row of each join, so no task holds a whole component."""
    now = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        seen = mark
        now = staged(_stars(_stars(now, True), False))
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
