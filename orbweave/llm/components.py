"""Connected components of a graph too large for one machine: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of numbers: each node and its component's least node, root. Nodes without an edge are not in the result.

    Numbers keep every aggregate a hash aggregate. Rows meet their node's least neighbour by the node's complement: dealt out anew, so
    that adaptive execution may split the rows of a hot node. Each step is written before the next, so lineage stays short; the
    number of steps grows with the logarithm of the longest path.
    """
    now = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    nodes = materialise(now.select("a").union(now.select("b")).distinct(), "nodes")
    seen = None
    while True:
        # Large star: every larger neighbour of a node goes to the least of the node and its neighbours.
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.withColumn("k", F.bitwise_not("u")).join(least, "k").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: a node and its smaller neighbours go to the least of these.
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("k"), "m")
        moved = down.withColumn("k", F.bitwise_not("u")).join(least, "k")
        small = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(moved.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = materialise(small.filter("a <> b").distinct(), "edges")
        discard(now)
        now = after
        sign = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")), F.lit(0))).first()
        if sign == seen:
            break
        seen = sign
    return nodes.join(now, "a", "left").select(F.col("a").alias("node"), F.coalesce("b", "a").alias("root"))
