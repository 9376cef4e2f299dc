"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from memlattice.session import discard, materialize


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """(node, component): every node that has an edge, with the smallest node of its component.

    Rounds of star contraction: each node links its larger neighbours to the smallest
    one it knows, then the smaller ones; the edge table shrinks to stars in
    O(log² n) rounds and then no longer changes, which the count and hash observed while
    a round is written show. Minima combine before the shuffle and each round is
    written to the shared folder, so neither a hub nor a lost executor hurts. Self-loops
    keep their node; null ends are dropped; no edges give no rows; a table that still
    changes after ``max_rounds`` raises an error.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    loops = e.where("u = v").select(F.col("u").alias("node"))
    e = materialize(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        # (u, v) with u > v: point everything next to u at the smallest label near u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        seen = Observation()
        new = small.unionByName(small_low.select("u", F.col("m").alias("v"))).distinct()
        new = new.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1000003).alias("h"), F.sum(F.xxhash64("v", "u") % 1000033).alias("g"))
        new = materialize(new, "cc")
        discard(e)
        e, now = new, tuple(seen.get.get(k) for k in "nhg")
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = members.unionByName(roots)
    alone = loops.distinct().join(found, "node", "left_anti").withColumn("component", F.col("node"))
    return found.unionByName(alone)
