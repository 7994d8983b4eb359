"""Connected components by randomised contraction, on written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomark.llm.common import cut, remove

MAX_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, root) for every node that has an edge.

    In each round every node moves to the neighbour of the smallest random rank, if that is below its own; edges are
    renamed, and self-loops and repeats go. The number of nodes falls by a constant factor a round in expectation.
    Minima are combined before the shuffle, so that hubs are no hot groups; joins leave skew to the engine.
    """
    spark = edges.sparkSession
    edges, path = cut(edges.where("a <> b").distinct(), "edges_0")
    steps: list[DataFrame] = []
    for r in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        rank = lambda c: F.xxhash64(c, F.lit(r))  # noqa: B023, E731
        order = lambda c: F.struct(rank(c).alias("k"), c.alias("v"))
        u, v = F.col("u"), F.col("v")
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        best = both.groupBy("u").agg(F.min(order(v)).alias("m"))
        moved: Column = F.least(F.col("m"), order(u))["v"]
        step, _ = cut(best.select("u", moved.alias("p")), f"step_{r}")
        steps.append(step)
        a, b = step.select(F.col("u").alias("a"), F.col("p").alias("pa")), step.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        new = edges.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        old = path
        edges, path = cut(new, f"edges_{r + 1}")
        remove(spark, old)
    if not steps:
        return spark.createDataFrame([], "node long, root long")
    out = steps[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for step in steps[1:]:
        out = out.join(step, out["root"] == step["u"], "left").select("node", F.coalesce("p", "root").alias("root"))
    return out
