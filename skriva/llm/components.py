"""Connected components of an edge table by alternating large and small stars; everything stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Each round takes the smallest neighbour of every node (an aggregate with map-side combining) and joins it back; a node with
    very many neighbours is a skewed join key, which adaptive execution can split. Rounds grow with the logarithm of the
    longest path. Null ends are ignored; an empty table gives an empty result."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    e, at, before = scratch.keep(e, f"{label}-0"), 0, None
    while True:
        at += 1
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: all larger neighbours of a node move to its smallest one.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.keep(large, f"{label}-{at}a")
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = scratch.keep(moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), f"{label}-{at}b")
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        scratch.drop(f"{label}-{at}a", f"{label}-{at - 1}b" if at > 1 else f"{label}-0")
        if state == before or not state[0]:
            break
        before = state
    # A fixed point is a forest of stars: every node but the roots has one edge, to its root.
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
