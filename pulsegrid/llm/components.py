"""Connected components by alternating large-star and small-star steps; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b of one orderable type); the component is the smallest node.

    Null ends and loops are ignored. A node with very many edges is pre-aggregated in the minimum, and the minima are
    written before they are joined, so that the adaptive skew join can split it; nothing is collected but three numbers
    a round, which tell whether the edges still change.
    """
    loops = edges.where("a is not null and b is not null")
    stars = loops.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    before, turn = None, 0
    while True:
        now = scratch.write(stars, f"{name}-{turn}")
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("hi", "lo").cast("long")), F.sum(F.hash("lo", "hi").cast("long"))).first())
        if turn:
            scratch.drop(f"{name}-{turn - 1}", *(f"{name}-{step}-{turn}" for step in ("least", "large", "low")))
        if seen[0] == 0 or seen == before:
            break
        before, turn = seen, turn + 1
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least-{turn}")
        large = scratch.write(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), f"{name}-large-{turn}")
        low = scratch.write(large.groupBy("hi").agg(F.min("lo").alias("m")), f"{name}-low-{turn}")
        pairs = large.join(low, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        stars = pairs.select("e.hi", "e.lo").where("hi <> lo").distinct()
    roots = now.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
