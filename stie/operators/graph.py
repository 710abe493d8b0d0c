"""Connected components on edge tables, without bringing the graph anywhere."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, root: the least node of the component of every node that has an edge to another. edges: keys, a, b of any type that has an order.

    Two steps take turns until nothing moves: each node's greater neighbours, then its lesser ones, are hung on the
    least node that it knows. The rounds grow with the logarithm of a chain's length; minima are summed up
    before the shuffle, and no node's neighbours are ever gathered. Every round is checkpointed.
    """
    now = reliable(edges.where(F.col("a") != F.col("b")).select(*keys, F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    was = None
    while (mark := now.agg(F.count("*"), F.sum(F.xxhash64(*keys, "x", "y").cast("decimal(38,0)"))).first()) != was:
        was = mark
        both = now.unionByName(now.select(*keys, F.col("y").alias("x"), F.col("x").alias("y")))
        known = both.groupBy(*keys, "x").agg(F.least(F.min("y"), F.first("x")).alias("low"))
        hung = both.where(F.col("y") > F.col("x")).join(known, [*keys, "x"]).select(*keys, F.col("y").alias("x"), F.col("low").alias("y")).distinct()
        lowest = hung.groupBy(*keys, "x").agg(F.min("y").alias("low"))
        others = hung.join(lowest, [*keys, "x"]).where(F.col("y") != F.col("low")).select(*keys, F.col("y").alias("x"), F.col("low").alias("y"))
        now = reliable(others.unionByName(lowest.select(*keys, "x", F.col("low").alias("y"))).distinct())
    return now.select(*keys, F.col("x").alias("node"), F.col("y").alias("root")).unionByName(now.select(*keys, F.col("y").alias("node"), F.col("y").alias("root")).distinct())
