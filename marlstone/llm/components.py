"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import discard, materialize


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component: the smallest node reachable.

    Alternating large-star and small-star steps.  Each step is a grouped minimum (combined on
    the map side) and an equi-join that adaptive execution can split, so a node with very many
    neighbours does not land in one task.  The edge list never grows, each round's edges
    go to the shared scratch folder, and only two counters come to the driver per round.
    Self-loops and repeated edges change nothing; an empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    cur, path = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), name)
    seen = None
    while True:
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large-star: each larger neighbour is linked to the smallest of the neighbourhood
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        # small-star: each smaller neighbour, and the node itself, is linked to the smallest of these
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct("m", F.col("a").alias("x")), F.struct("m", F.col("b").alias("x")))).alias("e")).select(F.col("e.m").alias("a"), F.col("e.x").alias("b")).filter("a <> b").distinct()
        nxt, nxt_path = materialize(small, name)
        # 128 bits over the set of edges: equal only where the step changed nothing
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        discard(spark, path)
        cur, path = nxt, nxt_path
        if now == seen or now[0] == 0:
            break
        seen = now
    stars = cur.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "node")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
