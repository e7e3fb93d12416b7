"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is joins and aggregations with map-side combine (no window over a hub's rows, which
would put them in one task), and is cut by a table in the shared folder. Nothing but the number of
edges and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import written


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """pairs (u, v): each u with a neighbour v. Links v (and u) to the least of u's neighbourhood."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = pairs.join(least, "u")
    if small:
        # pairs has v < u only, so m is the least neighbour and u itself moves to it too
        return linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
    return linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b), of one type, in any direction, loops and repeats allowed. Returns (node, root) for
    every node that can reach a lesser one; root is the least of them. Roots and nodes without edges are left out."""
    edges = edges.filter("a is not null and b is not null and a <> b")
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = written(_star(both, small=False), "large-star")
        now = written(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), small=True), "small-star")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError(f"components: not settled after {rounds} rounds")
