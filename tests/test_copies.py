"""Pairs of spans among many copies and in crowded buckets: against trying all, with spans of equal bounds judged once."""

import random

import pytest
from pyspark.sql import functions as F

from stie.operators import evaluation, intervals
from stie.plans import on_spans
from tests.test_whole_job import write_events

BOUNDS = "clip_id string, event_id long, side int, start_s double, end_s double, type string"


@pytest.fixture(params=[(50_000, 8), (7, 3), (1, 1)])
def held(request, monkeypatch):
    """Buckets whole, cut, and cut to single spans."""
    monkeypatch.setattr(intervals, "HELD", request.param[0])
    monkeypatch.setattr(intervals, "TOGETHER", request.param[1])


def copied(kinds, copies):
    """Spans of one side from even ids, of the other from odd ones, each with its copies; some reach over buckets, one has no length."""
    rng = random.Random(3)
    bounds = [(rng.choice("ab"), start := rng.randrange(9000) / 7, start + rng.randrange(1, 5000)) for _ in range(kinds)] + [("a", 100.0, 100.0), ("a", 3500.0, 3700.0), ("a", 3600.0, 3700.0)]
    return [(c, 2 * (len(bounds) * k + i) + i % 2, i % 2, s, e, rng.choice(["x", "y", None])) for k in range(copies) for i, (c, s, e) in enumerate(bounds)]


@pytest.mark.parametrize("typed", [False, True])
def test_candidates_are_those_of_trying_all(spark, held, typed):
    rows = copied(12, 5)
    rows.append(rows[0])  # an id twice
    expected = []
    for c, p, _, s, e, kind in (r for r in rows if r[2] == 0):
        for d, r, _, t, f, other in (r for r in rows if r[2] == 1):
            shared = min(e, f) - max(s, t)
            if c == d and shared > 0 and shared / (e - s + f - t - shared) >= 0.3 and (not typed or kind == other is not None):
                expected.append((c, p, s, e, kind, r, t, f, other, round(shared / (e - s + f - t - shared), 6)))
    df = spark.createDataFrame(rows, BOUNDS)
    found = evaluation.match_candidates(df, ["clip_id"], 0.3, typed, places=6)
    assert found.columns == ["clip_id", *df.columns[1:], *[f"r_{c}" for c in df.columns[1:]], "tiou"]
    got = found.select("clip_id", "event_id", "start_s", "end_s", "type", "r_event_id", "r_start_s", "r_end_s", "r_type", "tiou").collect()
    key = lambda r: tuple(str(x) for x in r)
    assert [tuple(r)[:-1] for r in sorted(got, key=key)] == [r[:-1] for r in sorted(expected, key=key)] and len(expected) > 50
    assert [r.tiou for r in sorted(got, key=key)] == pytest.approx([r[-1] for r in sorted(expected, key=key)], abs=2e-6)


def test_copies_are_judged_once(spark):
    """A hundred copies of everything: 10,000 times the pairs, and 13 times the rows that are judged."""
    seen, pairs = [], []
    for copies in (1, 100):
        df = spark.createDataFrame(copied(12, copies), BOUNDS).drop("type")
        found = intervals.pairs_of_bounds(df.where("side = 0"), df.where("side = 1"), ["clip_id"], lambda p: seen.append(p) or p)
        pairs.append(found.count())
    once, often = (p.count() for p in seen)
    assert pairs[0] == once > 10 and pairs[1] == 10_000 * pairs[0]
    assert often == -(-100 // intervals.TOGETHER) * once


def test_spans_without_other_columns_count_by_copies(spark, held):
    df = spark.createDataFrame([("a", 0.0, 10.0)] * 3 + [("a", 5.0, 15.0)] * 2, "clip_id string, start_s double, end_s double")
    found = intervals.pairs_of_bounds(df, df, ["clip_id"], lambda p: p)
    assert found.columns == ["clip_id", "start_s", "end_s", "r_start_s", "r_end_s"] and found.count() == 25
    assert found.where(F.col("start_s") == F.col("r_start_s")).count() == 13


def test_overlaps_of_a_vehicle_are_those_of_trying_all(spark, held, tmp_path):
    """Copies, ids that repeat, and spans without length; each pair once, the smaller id first."""
    rng = random.Random(5)
    kinds = [(rng.randrange(9000), rng.choice([1, 20, 60, 61, 300])) for _ in range(15)] + [(50, 1e-7), (50, 10)]
    rows = [(len(kinds) * k + i, s, m, "view") for k in range(4) for i, (s, m) in enumerate(kinds)]
    rows += [rows[3], (rows[3][0], 100, 200, "view")]
    got = on_spans.interval_overlap_pairs(spark, write_events(spark, tmp_path, rows)).collect()
    spans = [(i, s, round(s + m * 60, 3)) for i, s, m, _ in rows]
    expected = [(a[0], b[0], round(min(a[2], b[2]) - max(a[1], b[1]), 3)) for a in spans for b in spans if a[0] < b[0] and a[1] < b[2] and b[1] < a[2]]
    assert sorted((r.event_id, r.other_id, r.shared) for r in got) == sorted(expected) and len(expected) > 500


def test_overlaps_are_judged_once_for_copies(spark, tmp_path, monkeypatch):
    """What meets is judged by bounds, and in one order only: 30 copies of three spans are 4,005 pairs and six of bounds."""
    seen, pairs = [], intervals.pairs_of_bounds
    monkeypatch.setattr(intervals, "TOGETHER", 100)
    monkeypatch.setattr(intervals, "pairs_of_bounds", lambda left, right, keys, judged: pairs(left, right, keys, lambda p: seen.append(judged(p)) or seen[-1]))
    rows = [(3 * k + i, 100 + i, 10, "view") for k in range(30) for i in range(3)]
    assert on_spans.interval_overlap_pairs(spark, write_events(spark, tmp_path, rows)).count() == 90 * 89 // 2
    assert seen[0].count() == 6
