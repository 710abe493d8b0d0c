"""Scans over buckets give the rows of scans over whole keys."""

import random

import pytest
from pyspark.sql import functions as F

from stie.operators import intervals, tracks
from stie.operators.scan import Running, scanned

SPANS = "clip_id string, side int, start_s double, end_s double, id int"


def spans(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.choice([rng.random() * 3000, float(rng.randrange(0, 3000, 50))])
        rows.append((rng.choice(["hot", "hot", "hot", "b", None]), i % 2, start, start + rng.choice([0.5, 3.0, 50.0, 700.0 if i % 40 == 0 else 1.0]), i))
    return rows


@pytest.mark.parametrize("bucket", [10.0, 100.0, 1e6])
def test_unions_sweeps_and_merges(spark, bucket):
    df = spark.createDataFrame(spans(int(bucket)), SPANS)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(intervals.union(df, ["clip_id", "side"], bucket), intervals.union(df, ["clip_id", "side"]))
    assert same(intervals.merge_overlapping(df, ["clip_id"], bucket=bucket), intervals.merge_overlapping(df, ["clip_id"]))
    a, b = ({r[0]: r[1:] for r in intervals.occupancy(df, ["clip_id"], x).collect()} for x in (bucket, None))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


@pytest.mark.parametrize("how", ["nearest", "backward", "before", "forward"])
def test_lookups(spark, how):
    rng = random.Random(6)
    right = spark.createDataFrame([(k, float(t), t) for k in ("hot", "b", None) for t in sorted(rng.sample(range(3000), 40))], "clip_id string, at double, frame int")
    left = spark.createDataFrame(spans(9), SPANS)
    rows = lambda bucket: sorted(map(str, tracks.as_of(left, right, ["clip_id"], "start_s", "at", how, bucket).collect()))
    assert rows(25.0) == rows(None) == rows(700.0)


def test_running_values_of_awkward_rows(spark):
    rows = [("k", 1.0, None), ("k", 2.0, 5), ("k", 12.0, None), ("k", 33.0, 2), ("k", -4.0, 1), (None, 3.0, 3), (None, 14.0, 4)]
    df = spark.createDataFrame(rows, "k string, t double, v int")
    wanted = {"top": Running("max", F.col("v"), ("t",), own=False), "total": Running("sum", F.col("v"), ("t",)), "seen": Running("last", F.col("v"), ("t",)), "next": Running("last", F.col("v"), (F.desc("t"),), own=False, backwards=True)}
    a, b = (sorted(map(str, scanned(df, ["k"], F.col("t"), x, **wanted).collect())) for x in (10.0, None))
    assert a == b
    assert scanned(df.limit(0), ["k"], F.col("t"), 10.0, **wanted).count() == 0


def test_a_hot_clip_is_spread(spark):
    df = spark.range(5000).select(F.lit("hot").alias("clip_id"), F.lit(0).alias("side"), (F.col("id") * 1.0).alias("start_s"), (F.col("id") + 0.5).alias("end_s"))
    plan = intervals._islands(df, ["clip_id"], True, 50.0)._jdf.queryExecution().toString()
    assert "hashpartitioning(clip_id" in plan and "_part" in plan
    parts = scanned(df, ["clip_id"], F.col("start_s"), 50.0, reach=Running("max", F.col("end_s"), ("start_s",))).withColumn("task", F.spark_partition_id())
    assert parts.select("task").distinct().count() > 1
