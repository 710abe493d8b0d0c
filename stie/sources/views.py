"""Deterministic views that give the driver's tables the shape of clips, tracks and events.

Each view exists twice: as a DataFrame and as a SQL text for the oracle. Times are seconds within
the clip, rounded to milliseconds so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"signup": "enter", "error": "exit", "click": "door_operation", "view": "load_unload", "purchase": "other_interaction"}
DAY = 86400.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, event_id, type, person_id, vehicle_id, side (0 predicted, 1 reference), start_s, end_s: one span an event. Events without a positive value have no length, so no span."""
    events = read(spark, sf_dir, "events").where("value > 0").withColumn("at", F.col("ts").cast("timestamp"))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), F.col("event_type"))
    start = F.round((F.unix_micros("at") % 86_400_000_000) / 1e6, 3)
    return events.select(
        F.date_format("at", "yyyy-MM-dd").alias("clip_id"), "event_id", kind.alias("type"), F.col("user_id").alias("person_id"),
        (F.get_json_object("props", "$.k").cast("long") % 10).alias("vehicle_id"), (F.col("event_id") % 2).alias("side"),
        start.alias("start_s"), F.round(start + F.col("value") * 60, 3).alias("end_s"), F.floor(start / 1200).cast("long").alias("slot"),
    )


SPANS = """spans AS (SELECT strftime(ts, '%Y-%m-%d') AS clip_id, event_id,
  CASE event_type WHEN 'signup' THEN 'enter' WHEN 'error' THEN 'exit' WHEN 'click' THEN 'door_operation' WHEN 'view' THEN 'load_unload' ELSE 'other_interaction' END AS type,
  user_id AS person_id, (props->>'$.k')::BIGINT % 10 AS vehicle_id, event_id % 2 AS side,
  round((epoch_us(ts) % 86400000000) / 1e6, 3) AS start_s, round(round((epoch_us(ts) % 86400000000) / 1e6, 3) + value * 60, 3) AS end_s,
  floor(round((epoch_us(ts) % 86400000000) / 1e6, 3) / 1200)::BIGINT AS slot
  FROM events WHERE value > 0)"""

DURATION = 36.7
HALF = 183


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, frame_index, ts, scene, id, kind, x1, y1, x2, y2, conf: one box of one track in one frame."""
    items = read(spark, sf_dir, "lineitem").withColumn("day", F.col("l_shipdate").cast("timestamp"))
    boxes = items.groupBy(F.year("day").alias("clip_id"), F.dayofyear("day").alias("frame_index"), F.col("l_suppkey").alias("id")).agg(
        F.min("l_quantity").alias("q"), F.min("l_discount").alias("discount")
    )
    person = F.col("id") % 3 == 0
    x1, y1 = (F.col("id") * 37 + F.col("frame_index") * 3) % 600, (F.col("id") * 53) % 400
    return boxes.select(
        "clip_id", "frame_index", F.round(F.col("frame_index") * F.lit(0.1), 1).alias("ts"), F.when(F.col("frame_index") >= HALF, 1).otherwise(0).alias("scene"), "id",
        F.when(person, "person").otherwise("car").alias("kind"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
        (x1 + F.when(person, 20).otherwise(80) + F.col("q")).alias("x2"), (y1 + F.when(person, 50).otherwise(60) + F.col("q")).alias("y2"),
        F.round(1 - F.col("discount"), 2).alias("conf"),
    )


TRACKS = """tracks AS (SELECT clip_id, frame_index, round(frame_index * 0.1::DOUBLE, 1) AS ts, CASE WHEN frame_index >= 183 THEN 1 ELSE 0 END AS scene, id,
  CASE WHEN id % 3 = 0 THEN 'person' ELSE 'car' END AS kind,
  ((id * 37 + frame_index * 3) % 600)::DOUBLE AS x1, ((id * 53) % 400)::DOUBLE AS y1,
  (id * 37 + frame_index * 3) % 600 + CASE WHEN id % 3 = 0 THEN 20 ELSE 80 END + q AS x2,
  (id * 53) % 400 + CASE WHEN id % 3 = 0 THEN 50 ELSE 60 END + q AS y2, round(1 - discount, 2) AS conf
  FROM (SELECT year(l_shipdate)::INT AS clip_id, dayofyear(l_shipdate)::INT AS frame_index, l_suppkey AS id, min(l_quantity) AS q, min(l_discount) AS discount
        FROM lineitem GROUP BY ALL))"""


def frames_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, obj, kind, x1, y1, x2, y2, conf: crowded frames; an order is a frame."""
    items = read(spark, sf_dir, "lineitem")
    name = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")
    x1, y1 = F.col("l_partkey") % 640, F.col("l_suppkey") * 4
    return items.select(
        F.col("l_orderkey").alias("frame"), name.alias("obj"), F.when(F.col("l_returnflag") == "R", "person").otherwise("car").alias("kind"),
        x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), (x1 + F.col("l_quantity") * 2 + 10).alias("x2"), (y1 + F.col("l_quantity") * 4 + 10).alias("y2"),
        F.round(1 - F.col("l_discount"), 2).alias("conf"),
    ).dropDuplicates(["frame", "obj"])


FRAMES = """fo AS (SELECT DISTINCT ON (frame, obj) * FROM (SELECT l_orderkey AS frame, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS obj,
  CASE WHEN l_returnflag = 'R' THEN 'person' ELSE 'car' END AS kind, (l_partkey % 640)::DOUBLE AS x1, (l_suppkey * 4)::DOUBLE AS y1,
  l_partkey % 640 + l_quantity * 2 + 10 AS x2, l_suppkey * 4 + l_quantity * 4 + 10 AS y2, round(1 - l_discount, 2) AS conf FROM lineitem))"""
