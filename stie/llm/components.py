"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stie.llm.common import reliable


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every node but the roots. edges: a, b longs.

    Every round hangs neighbours on the least node they know; minima are partial sums before
    the shuffle, and the joins are plain equi-joins that Spark may split. Each round is
    checkpointed. Self-loops are dropped, directions and repetitions don't count.
    """
    now = reliable(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    was = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if mark == was:
            return now.select(F.col("x").alias("node"), F.col("y").alias("root"))
        was = mark
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where(F.col("y") > F.col("x")).join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where(F.col("x") != F.col("y")).distinct()
        lowest = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(lowest, "x").where(F.col("y") != F.col("m")).select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(lowest.select("x", F.col("m").alias("y")))
        now = reliable(small.distinct())
    raise RuntimeError(f"no fixed point in {rounds} rounds")
