"""What the llm operators share on the driver's side: reading tables, splits, reliable cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tables that small() broadcasts have so many rows at most.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no model learns from: crc32(doc_id as text) mod 5 = 0; a null id is in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session may do without: it gets one of its own."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: columns that are not read later cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def pieces(df: DataFrame, text: str = "text", size: int = 8 << 20, least: int = 32) -> int:
    """How many pieces of about `size` bytes of text the table has; grows with the table."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, -(-total // size))


def small(df: DataFrame) -> DataFrame:
    """The table with a hint to broadcast it, if it has few rows now; otherwise it meets others in a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `at`, their place within `tree` from 0, and `n`, the rows of the tree; nulls come first.

    One range sort over all tasks; rows that are equal in all of `order` are spread too. Places follow from the
    counts of (tree, task).
    """
    tasks = max(32, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order], F.col("_any")]
    spread = rows.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(tasks, *by).sortWithinPartitions(*by).drop("_any")
    spread = written(spread.withColumn("_task", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    held = spread.groupBy("tree", "_task").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy("tree").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = held.select("tree", "_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(W.partitionBy("tree")).alias("n"))
    return spread.join(small(offsets), ["tree", "_task"]).withColumn("at", F.col("_row") + F.col("_shift")).drop("_task", "_row", "_shift")
