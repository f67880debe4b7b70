"""Connected components of an edge table, by alternating large and small stars.

Nothing is collected: each round replaces edges by edges to smaller neighbours, with one
grouped minimum and one equi-join, and the result of each round is a table in shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b.  large: every larger neighbour of a node joins the node's minimum; else every smaller one and the node itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        least = least.select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's least node) of every node of edges (a, b) but the roots themselves."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "edges")
    mark = None
    while True:
        now = materialize(_star(_star(now, True), False), "edges")
        # A count and an order-free fingerprint of the edges tell whether a round changed them.
        fresh = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if fresh == mark or not fresh[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = fresh
