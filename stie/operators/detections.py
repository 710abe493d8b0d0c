"""Detections before they are tracks: heads, attribution, crops, and the checks of what is drawn from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stie.functions import geometry as G
from stie.operators.tracks import as_of
from stie.operators.verify import evenly

CORNERS = ("x1", "y1", "x2", "y2")


def _named(df: DataFrame, frame: list[str], prefix: str) -> DataFrame:
    return df.select(*frame, *[F.col(c).alias(prefix + c) for c in df.columns if c not in frame])


def new_heads(heads: DataFrame, people: DataFrame, vehicles: DataFrame, frame: list[str], margin: float = 0.12, reach: float = 0.2, widest: float = 0.0) -> DataFrame:
    """Heads of people that no person box has: the center is in no person box (with a margin).

    If `widest` is not 0, heads wider than that share of a vehicle that holds their center (with
    the margin `reach`) go too. heads, people, vehicles: frame, obj, corners.
    """
    h = _named(heads, frame, "h_")
    head, person, vehicle = G.Box.of("h_"), G.Box.of("p_"), G.Box.of("v_")
    gone = h.join(_named(people, frame, "p_"), frame).where(G.contains(person, *head.center, margin)).select(*frame, F.col("h_obj").alias("obj"))
    if widest:
        wide = F.greatest(head.width, F.lit(1.0)) > widest * F.greatest(vehicle.width, F.lit(1.0))
        huge = h.join(_named(vehicles, frame, "v_"), frame).where(G.contains(vehicle, *head.center, reach) & wide)
        gone = gone.unionByName(huge.select(*frame, F.col("h_obj").alias("obj")))
    return heads.join(gone.distinct(), [*frame, "obj"], "left_anti")


def attributed(tracked: DataFrame, heads: DataFrame, free: DataFrame, frame: list[str], least: float = 0.35, margin: float = 0.05, width: float = 1e9, height: float = 1e9) -> DataFrame:
    """tracked with head_obj: the free head whose inferred body it overlaps most; else the uppermost, then widest, of all heads inside it; null without one.

    free: the heads that stand for people of their own (new_heads).
    """
    t = _named(tracked, frame, "t_")
    box, head = G.Box.of("t_"), G.Box.of("h_")
    own = [*frame, F.col("t_obj").alias("obj")]
    bodies = t.join(_named(free, frame, "h_"), frame).withColumn("_iou", G.iou(box, G.body_from_head(head, width, height))).where(F.col("_iou") >= least)
    by_body = bodies.groupBy(*own).agg(F.min_by("h_obj", F.struct(-F.round("_iou", 9), F.col("h_obj"))).alias("_body"))
    held = t.join(_named(heads, frame, "h_"), frame).where(G.contains(box, *head.center, margin))
    inside = held.groupBy(*own).agg(F.min_by("h_obj", F.struct(head.center[1], -head.width, F.col("h_obj"))).alias("_inside"))
    found = tracked.join(by_body, [*frame, "obj"], "left").join(inside, [*frame, "obj"], "left")
    return found.withColumn("head_obj", F.coalesce("_body", "_inside")).drop("_body", "_inside")


def time_gate(frames: list[dict], fps: float, start: float = 0.0) -> Iterable[dict]:
    """Frames from `start` on, each at least 1 / fps after the one before; for folds.fold()."""
    due = start
    for frame in frames:
        if frame["ts"] + 1e-6 >= due:
            yield frame
            due = frame["ts"] + 1 / fps


def review_frames(frames: DataFrame, spans: DataFrame, keys: list[str], count: int = 8) -> DataFrame:
    """keys, ts: evenly spread frames and the frames on both sides of the start, middle and end of every span."""
    numbered = frames.withColumns({"_i": F.row_number().over(W.partitionBy(*keys).orderBy("ts")) - 1, "_n": F.count("*").over(W.partitionBy(*keys))})
    even = numbered.where(evenly(F.col("_i"), F.col("_n"), count)).select(*keys, "ts")
    bounds = spans.select(*keys, F.explode(F.array(F.col("start_s"), (F.col("start_s") + F.col("end_s")) / 2, F.col("end_s"))).alias("t")).distinct()
    before = as_of(bounds, frames, keys, "t", "ts", "before").select(*keys, "ts")
    after = as_of(bounds, frames, keys, "t", "ts", "forward").select(*keys, "ts")
    return even.unionByName(before).unionByName(after).where(F.col("ts").isNotNull()).distinct()


def render_quality(expected: DataFrame, drawn: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frames, agreement, max_time_error: drawn frames against expected ones. Both: keys, frame_index, ts, active (array of ids)."""
    other = drawn.select(*keys, "frame_index", F.col("ts").alias("_ts"), F.col("active").alias("_active"))
    both = expected.join(other, [*keys, "frame_index"], "full_outer")
    same = F.coalesce(F.sort_array("active") == F.sort_array("_active"), F.lit(False))
    return both.groupBy(*keys).agg(F.count("*").alias("frames"), F.round(F.avg(same.cast("int")), 6).alias("agreement"), F.round(F.max(F.abs(F.col("ts") - F.col("_ts"))), 6).alias("max_time_error"))


def pair_present(frames: DataFrame, keys: list[str], person: str, vehicle: str) -> DataFrame:
    """keys of candidates for which some sampled frame shows both. frames: keys, ids, and the columns named."""
    return frames.where(F.array_contains("ids", F.col(person)) & F.array_contains("ids", F.col(vehicle))).select(*keys).distinct()
