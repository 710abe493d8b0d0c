"""Candidate proposal under the configuration, on small rows and against a plain version of the choice of vehicles."""

import random
from dataclasses import fields, replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from stie.config import DEFAULT, HELD, RELEASED, Config
from stie.operators import candidates, events, folds, tracks, workflow
from stie.plans import catalogue
from tests import plain

BOX = "clip_id string, frame_index int, ts double, scene int, id string, kind string, x1 double, y1 double, x2 double, y2 double, conf double"
HEADED = BOX + ", head_x1 double, head_y1 double, head_x2 double, head_y2 double"


def box(t, name, x1, y1, x2, y2, conf=0.9, scene=0, clip="c"):
    return (clip, round(t * 10), float(t), scene, name, "person" if name.startswith("p") else "car", float(x1), float(y1), float(x2), float(y2), conf)


def found(spark, rows, duration=6.0, schema=BOX, **options):
    config = replace(DEFAULT, candidate_gap_s=1.0, **options)
    return [tuple(r) for r in candidates.propose(spark.createDataFrame(rows, schema), duration, config).orderBy("clip_id", "candidate_id").select("person_id", "vehicle_id", "start_s", "end_s", "candidate_id").collect()]


def pairs(*args, **options):
    return [r[:2] for r in found(*args, **options)]


def test_near_people_only_and_scenes_apart(spark):
    rows = [box(2, "p1", 19, 0, 22, 8), box(2, "p2", 300, 0, 320, 8), box(2, "v", 0, 0, 20, 10)]
    assert found(spark, rows, context_s=1.0) == [("p1", "v", 1.0, 3.0, "c0001")]
    assert pairs(spark, rows, near_margin=20.0) == [("p1", "v"), ("p2", "v")]
    assert len(found(spark, [box(t, n, 0, 0, 9, 9, scene=s) for t, s in ((1, 0), (1.5, 1)) for n in ("p", "v")])) == 2


def test_heads_measure_distance(spark):
    head = lambda row, *h: (*row, *(float(x) for x in h)) if h else (*row, None, None, None, None)
    rows = [head(box(1, "v", 40, 0, 80, 40)), head(box(1, "p_big", 0, 0, 20, 40), 4, 0, 16, 12), head(box(1, "p_small", 100, 0, 120, 40), 106, 0, 110, 4), head(box(1, "p_none", 81, 0, 90, 40))]
    assert pairs(spark, rows, schema=HEADED, near_margin=0.05, head_scaled_distance=True, max_head_widths=2.0) == [("p_big", "v"), ("p_none", "v")]
    assert pairs(spark, rows, schema=HEADED, near_margin=0.05, head_scaled_distance=True, max_head_widths=5.0) == [("p_big", "v"), ("p_none", "v"), ("p_small", "v")]
    assert pairs(spark, rows, schema=HEADED, near_margin=0.05) == [("p_none", "v")]


def test_one_vehicle_or_all(spark):
    rows = [box(1, "p", 190, 90, 230, 170), box(1, "v_far", 0, 0, 210, 100, 0.95), box(1, "v_near", 20, 70, 200, 200, 0.6)]
    assert pairs(spark, rows, near_margin=0.3) == [("p", "v_near")]
    assert pairs(spark, rows, near_margin=0.3, center_weight=0.0) == [("p", "v_far")]
    assert pairs(spark, rows, near_margin=0.3, confidence_weight=5.0) == [("p", "v_far")]
    assert pairs(spark, rows, near_margin=0.3, exclusive_person_vehicle=False) == [("p", "v_far"), ("p", "v_near")]


def test_a_missing_vehicle_is_waited_for(spark):
    person = lambda t: box(t, "p", 180, 40, 220, 140)
    own, other = (0, 0, 200, 160), (190, 0, 390, 160)
    rows = [person(0), box(0, "v_own", *own), person(1), box(1, "v_other", *other), person(2), box(2, "v_own", *own), box(2, "v_other", *other)]
    options = dict(candidate_gap_s=2.0, context_s=0.1, hysteresis_max_gap_s=3.0, hysteresis=True)
    run = lambda **more: {r[1] for r in pairs_of(spark, rows, replace(DEFAULT, **{**options, **more}))}
    assert run(hold_when_missing=True) == {"v_own"}
    assert run(hold_when_missing=False) == {"v_own", "v_other"}
    assert run(hold_when_missing=True, hysteresis_max_gap_s=0.5) == {"v_own", "v_other"}
    assert run(hysteresis=False) == {"v_own", "v_other"}


def pairs_of(spark, rows, config):
    return [(r.person_id, r.vehicle_id) for r in candidates.propose(spark.createDataFrame(rows, BOX), 6.0, config).collect()]


def test_a_small_gain_does_not_switch(spark):
    rows = [r for t, x in ((0.0, 95), (0.1, 112)) for r in (box(t, "p", x, 0, x + 10, 40), box(t, "v1", 0, 0, 100, 60), box(t, "v2", 120, 0, 220, 60))]
    assert set(pairs(spark, rows, hysteresis=True, switch_margin=0.5)) == {("p", "v1")}
    assert set(pairs(spark, rows, hysteresis=True, switch_margin=0.0)) == {("p", "v1"), ("p", "v2")}


def test_tracks_are_valid_by_length_or_by_touching(spark):
    upright = [box(t, "p", 16 + 20 * t, 0, 20 + 20 * t, 10) for t in (0.0, 0.1)]
    flat = [box(t, "p", 22, 4, 34, 10) for t in (0.0, 0.1)]
    car = [box(t, "v", 20, 0, 40, 12) for t in (0.0, 0.1)]
    strict = dict(person_track_min_detections=5, person_track_min_duration_s=0.75)
    assert pairs(spark, upright + car) == [("p", "v")] and pairs(spark, upright + car, **strict) == []
    assert pairs(spark, upright + car, short_track_vehicle_exception=True, **strict) == [("p", "v")]
    assert pairs(spark, flat + car, short_track_vehicle_exception=True, **strict) == []
    assert pairs(spark, flat + car, short_track_vehicle_exception=True, short_track_min_aspect_ratio=0.4, **strict) == [("p", "v")]
    assert pairs(spark, upright + car, short_track_vehicle_exception=True, short_track_min_detections=3, **strict) == []
    long = [box(0.1 * k, "p", 200 if k != 5 else 41, 0, 210 if k != 5 else 45, 20) for k in range(11)] + [box(0.1 * k, "v", 20, 0, 40, 12) for k in range(11)]
    assert pairs(spark, long, person_track_min_detections=11, person_track_min_duration_s=1.0) == [("p", "v")] and pairs(spark, long, person_track_min_detections=12) == []
    only = dict(person_track_min_detections=99, short_track_vehicle_exception=True)
    assert pairs(spark, long, **only, short_track_endpoint_frames=2) == [] and pairs(spark, long, **only, short_track_endpoint_frames=6) == [("p", "v")]


def test_a_body_prefers_its_depth(spark):
    rows = [box(1, "p", 500, 340, 580, 540, 0.8), box(1, "v_lower", 0, 330, 480, 670), box(1, "v_upper", 88, 150, 520, 366)]
    options = dict(near_margin=0.6, center_weight=0.0, confidence_weight=0.0, horizontal_body=True)
    assert pairs(spark, rows, **options) == [("p", "v_lower")]
    for change in (dict(horizontal_body=False), dict(body_min_aspect_ratio=3.0), dict(body_min_confidence=0.85), dict(body_anchor=0.05, body_margin=0.0), dict(body_miss=0.0)):
        assert pairs(spark, rows, **{**options, **change}) == [("p", "v_upper")], change
    assert pairs(spark, [rows[0], rows[2]], **options) == [("p", "v_upper")]


def test_a_probe_of_the_first_vehicle(spark):
    rows = [box(0.0, "v_small", 0, 0, 20, 10), box(0.0, "v_big", 100, 0, 180, 50), box(0.5, "v_big", 100, 0, 180, 50), box(3.0, "p", 20, 0, 24, 10), box(3.0, "v_small", 0, 0, 20, 10), box(0.0, "p", 0, 0, 5, 5, clip="d"), box(0.0, "v", 0, 0, 9, 9, clip="d")]
    assert found(spark, rows, initial_vehicle_exit_probe_s=1.0, context_s=1.5) == [("untracked_v_big", "v_big", 0.0, 1.5, "c0001"), ("p", "v_small", 1.5, 4.5, "c0002"), ("p", "v", 0.0, 1.5, "c0001")]
    assert found(spark, rows, initial_vehicle_exit_probe_s=5.0)[0][0] == "p"
    assert found(spark, rows)[0][:2] == ("p", "v_small")


def test_windows_cover_long_encounters(spark):
    rows = [r for k in range(0, 200, 5) for r in (box(k / 10, "p", 0, 0, 5, 9), box(k / 10, "v", 0, 0, 20, 9))]
    got = [(r[2], r[3]) for r in found(spark, rows, duration=30.0, context_s=1.0)]
    assert got == [(0.0, 8.0), (6.0, 14.0), (12.0, 20.0), (18.0, 20.5)]
    assert [(r[2], r[3]) for r in found(spark, rows, duration=30.0, context_s=0.0, window_s=30.0)] == [(0.0, 19.5)]


@pytest.mark.parametrize("hold", [False, True])
def test_vehicles_are_held_as_a_walk_holds_them(hold):
    rng = random.Random(5)
    for _ in range(300):
        rows = sorted({(rng.choice([0.2, 0.4, 0.5]) * rng.randrange(12), rng.randrange(3)): rng.choice([0.0, 0.02, 0.1, 0.3]) for _ in range(rng.randrange(1, 30))}.items(), key=lambda r: (r[0][0], r[1], r[0][1]))
        near = [{"at": at, "vehicle": v, "rank": r} for (at, v), r in rows]
        at, vehicle, rank = (np.array([r[c] for r in near]) for c in ("at", "vehicle", "rank"))
        gap, margin = rng.choice([0.3, 1.0]), rng.choice([0.0, 0.05, 0.2])
        assert folds.held_vehicle(at, vehicle, rank, gap, margin, hold).tolist() == list(plain.keep(near, gap, margin, hold))


def test_picked_rows_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(300).select(F.concat(F.lit("k"), (F.col("id") % 11).cast("string")).alias("k"), F.col("id").alias("v"))
        df = df.unionByName(df.limit(3).withColumn("k", F.lit(None).cast("string")))
        kept = folds.picked(df, ["k"], ["v"], lambda c: np.array([0, len(c["v"]) - 1]), ["v"]).groupBy("k").agg(F.min("v").alias("a"), F.max("v").alias("z"), F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.k, r.a, r.z, r.n) for r in kept} == {(f"k{i}", i, max(range(i, 300, 11)), 2) for i in range(11)}


def test_no_boxes_no_candidates(spark):
    for config in (DEFAULT, HELD, RELEASED, replace(RELEASED, initial_vehicle_exit_probe_s=2.0)):
        assert candidates.propose(spark.createDataFrame([], BOX), 5.0, config).count() == 0


def test_every_parameter_is_read():
    """No field of the configuration is without a reader in the operators."""
    import inspect

    from stie.operators import emergence, expansion, verification, verify

    text = "".join(inspect.getsource(m) for m in (candidates, events, workflow, verification, verify, emergence, expansion, tracks))
    assert [f.name for f in fields(Config) if f"config.{f.name}" not in text] == []
    with pytest.raises(ValueError, match="no verifier"):
        workflow.run(None, 1.0, replace(DEFAULT, verifier="unheard of"))


def test_a_filter_looks_for_vehicles_once(spark, sf, monkeypatch):
    made, found = [], tracks.best_ranked
    monkeypatch.setattr(tracks, "best_ranked", lambda *a: made.append(1) or found(*a))
    kept = {(r.clip_id, r.event_id) for r in catalogue.QUERIES["classifier_filter"](spark, sf).collect()}
    assert kept and len(made) == 1
