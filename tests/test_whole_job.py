"""Queries do the whole job: small tables whose answers are found by trying everything."""

import datetime as dt
import itertools
import json
import random

import pytest

from stie.plans import catalogue
from stie.sources.views import tracks

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def write_events(spark, folder, rows):
    """rows: id (odd is a reference), start in seconds of the day, minutes, type."""
    day = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    data = [(i, day + dt.timedelta(seconds=s), i, kind, float(m), json.dumps({"k": 1})) for i, s, m, kind in rows]
    spark.createDataFrame(data, EVENTS).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    return str(folder)


def iou(a, b):
    shared = min(a[1] + a[2] * 60, b[1] + b[2] * 60) - max(a[1], b[1])
    return shared / (60 * (a[2] + b[2]) - shared)


def best_matching(left, right, typed=False):
    """The most pairs and their greatest sum, over all assignments."""
    right = right + [None] * len(left)
    tries = ([iou(a, b) for a, b in zip(left, p, strict=True) if b and iou(a, b) >= 0.3 and not (typed and a[3] != b[3])] for p in itertools.permutations(right, len(left)))
    return max((len(t), sum(t)) for t in tries)


@pytest.fixture(scope="module")
def matching(spark, tmp_path_factory):
    """Long spans that start around the ends of 20-minute slots."""
    rng = random.Random(8)
    rows = [(i, 1150 + 1200 * (i % 3) + rng.randrange(100), rng.randrange(20, 70), rng.choice(["signup", "error"])) for i in range(10)]
    return write_events(spark, tmp_path_factory.mktemp("events"), rows), [r for r in rows if r[0] % 2 == 0], [r for r in rows if r[0] % 2]


def test_spans_that_start_in_different_slots_are_matched(spark, matching):
    folder, left, right = matching
    run = lambda name: catalogue.QUERIES[name](spark, folder).collect()
    pairs = {(a[0], b[0]) for a in left for b in right if iou(a, b) >= 0.3}
    assert any(a[1] // 1200 != b[1] // 1200 for a in left for b in right if (a[0], b[0]) in pairs)
    assert {(r.event_id, r.r_event_id) for r in run("match_candidates")} == pairs
    n, total = best_matching(left, right)
    (row,) = run("matched_events")
    assert row.n == n and row.total == pytest.approx(total, abs=1e-5)
    for row in run("event_kpis"):
        assert (row.tp, row.fp, row.fn) == (n, len(left) - n, len(right) - n) and row.alarms_per_min == pytest.approx((len(left) - n) / 1440, abs=1e-6)
    assert sum(r.tp for r in run("kpi_by_type")) == best_matching(left, right, typed=True)[0]
    assert run("boundary_errors")[0].n == n
    table = {r.truth: r for r in run("confusion")}
    assert sum(r.missed for r in table.values()) == len(right) - n


def test_labels_reach_across_slots(spark, tmp_path):
    rows = [(0, 1100, 30, "signup"), (1, 1300, 20, "error"), (2, 40000, 30, "signup"), (3, 41000, 30, "purchase"), (4, 80000, 1, "signup")]
    got = catalogue.QUERIES["labelled_candidates"](spark, write_events(spark, tmp_path, rows)).collect()
    assert {(r.candidate_id, r.label) for r in got} == {(0, 1), (4, 0)}


def test_instants_of_all_tracks_reach_all_frames(spark, sf):
    frames, ends = {}, {}
    for r in tracks(spark, sf).select("clip_id", "id", "ts").collect():
        frames.setdefault(r.clip_id, set()).add(r.ts)
        ends.setdefault((r.clip_id, r.id), []).append(r.ts)
    instants = {(c, round(t, 3)) for (c, _), x in ends.items() for t in (min(x), (min(x) + max(x)) / 2, max(x))}
    near = {(r.clip_id, r.t): r for r in catalogue.QUERIES["nearest_frame"](spark, sf).collect()}
    both = {(r.clip_id, r.t): r for r in catalogue.QUERIES["asof_forward_backward"](spark, sf).collect()}
    assert set(near) == set(both) == instants
    for c, t in instants:
        assert near[c, t].ts == min(frames[c], key=lambda x: (round(abs(x - t), 9), x)) and round(near[c, t].frame_index * 0.1, 1) == near[c, t].ts
        assert both[c, t].before == max(x for x in frames[c] if x <= t) and both[c, t].after == min(x for x in frames[c] if x >= t)
