"""Citation snowball: frontier joins over an edge table, hop by hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.sources.tables import written

def snowball(edges: DataFrame, seeds: DataFrame, gate: Column, hops: int = 2, budget: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """(node, hop, status): from the seeds, follow edges (src, dst); a node is taken once, at its first hop.
    `gate` (over dst, and title where edges have one) decides pass or gated; gated nodes are seen but don't
    expand; nodes of `known` are marked so and don't expand either. With a budget, only that many passing
    nodes in all are taken, by node (JN7).

    Each hop is one equi join of frontier and edges and one anti join with what was seen, written to the
    shared folder, so the plan doesn't grow with the hops and a lost executor repeats a hop at most.
    """
    seen = written(seeds.select(F.col("node")).distinct().withColumn("hop", F.lit(0)).withColumn("status", F.lit("seed")))
    front, left = seen.select("node"), budget
    for hop in range(1, hops + 1):
        new = edges.join(front, edges["src"] == front["node"]).withColumn("_g", gate).groupBy("dst").agg(F.max(F.coalesce("_g", F.lit(False))).alias("ok"))
        new = new.withColumnRenamed("dst", "node").join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop))
        if known is not None:
            new = new.join(known.select("node").distinct().withColumn("_k", F.lit(True)), "node", "left")
        else:
            new = new.withColumn("_k", F.lit(None).cast("boolean"))
        new = written(new.select("node", "hop", F.when(F.col("_k").isNotNull(), "known").when(F.col("ok"), "passed").otherwise("gated").alias("status")))
        passed = new.where("status = 'passed'")
        if left is not None:
            taken = written(passed.orderBy("node").limit(left))
            new = new.where("status <> 'passed'").unionByName(taken)
            left = left - taken.count()
            passed = taken
        seen = seen.unionByName(new)
        front = passed.select("node")
        if left == 0:
            break
    return seen
