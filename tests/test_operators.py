"""Operators on small rows with known results."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stie.config import DEFAULT, RELEASED, Config
from stie.functions import geometry as G
from stie.functions import text as X
from stie.operators import detections, emergence, evaluation, events, exclusive, graph, intervals, learning, suppress, tracks, verify
from stie.plans import reports
from tests import plain

BOX = "clip_id string, frame_index int, ts double, scene int, id string, kind string, x1 double, y1 double, x2 double, y2 double, conf double"
EVENTS = "clip_id string, type string, person_id string, vehicle_id string, start_s double, end_s double"
SPANS = "clip_id string, event_id long, type string, person_id string, vehicle_id string, side long, start_s double, end_s double"


def box(i, t, name, x1, y1, x2, y2, conf=0.9, scene=0, kind=None):
    return ("c", i, t, scene, name, kind or ("person" if name[0] == "p" else "car"), float(x1), float(y1), float(x2), float(y2), conf)


def test_the_nearer_center_wins(spark):
    rows = [box(0, 0.0, "p", 95, 45, 115, 85), box(0, 0.0, "v_far", 0, 0, 105, 50, 0.9), box(0, 0.0, "v_near", 10, 35, 100, 100, 0.8)]
    best = tracks.nearest(tracks.ranked(spark.createDataFrame(rows, BOX), 0.3, 0.2), ["clip_id", "frame_index", "person_id"], [F.col("rank"), F.col("vehicle_id")]).collect()
    assert [r.vehicle_id for r in best] == ["v_near"]


def test_upright_body_prefers_a_vehicle_at_its_depth(spark):
    rows = [box(0, 0.0, "p", 250, 170, 290, 270, 0.8), box(0, 0.0, "lower", 0, 165, 240, 335, kind="car"), box(0, 0.0, "upper", 44, 75, 260, 183, kind="car")]
    for chosen, expected in ((rows, "lower"), ([rows[0], rows[2]], "upper")):
        got = tracks.ranked(spark.createDataFrame(chosen, BOX), 0.6, 0.0, 0.0, body=True).orderBy("rank").first()
        assert got.vehicle_id == expected


def test_short_tracks(spark):
    upright = [box(i, t, "p", x, 0, x + 2, 5) for i, t, x in ((0, 0.0, 8), (1, 0.1, 9))] + [box(i, t, "v", 10, 0, 20, 6) for i, t in ((0, 0.0), (1, 0.1))]
    wide = [box(i, t, "p", 11, 2, 17, 5) for i, t in ((0, 0.0), (1, 0.1))] + upright[2:]
    assert tracks.short_exceptions(spark.createDataFrame(upright, BOX), ["clip_id", "id"]).count() == 1
    assert tracks.short_exceptions(spark.createDataFrame(wide, BOX), ["clip_id", "id"]).count() == 0


def test_head_scaled_proximity(spark):
    rows = [("near", 0.0, 0.0, 10.0, 20.0, 2.0, 8.0), ("far", 50.0, 0.0, 60.0, 20.0, 53.0, 55.0)]
    df = spark.createDataFrame(rows, "id string, x1 double, y1 double, x2 double, y2 double, h1 double, h2 double")
    vehicle = G.Box(*(F.lit(v) for v in (20.0, 20.0, 40.0, 20.0)))
    vehicle = G.Box(F.lit(20.0), F.lit(0.0), F.lit(40.0), F.lit(20.0))
    head = G.Box(F.col("h1"), F.lit(0.0), F.col("h2"), F.lit(6.0))
    assert [r.id for r in df.where(G.near_with_head(G.Box.of(), vehicle, head, 0.01, 2.0)).collect()] == ["near"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 10)), min_size=1, max_size=12), st.integers(0, 3))
def test_sliding_window_count(parts, _):
    for start, length in parts:
        window, overlap = 8.0, 2.0
        n, at = 0, float(start)
        while True:
            n += 1
            if min(start + length, at + window) == start + length:
                break
            at += window - overlap
        assert n == max(1, int(np.ceil((length - overlap) / (window - overlap) - 1e-9)))


def test_union_and_merge_differ_where_spans_touch(spark):
    rows = [("c", "enter", "p", "v", 1.0, 3.0), ("c", "enter", "p", "v", 3.0, 4.0), ("c", "enter", "p", "v", 3.5, 5.0), ("c", "enter", "p", "v", 6.0, 7.0)]
    df = spark.createDataFrame(rows, EVENTS)
    keys = ["clip_id", "type", "person_id", "vehicle_id"]
    assert sorted((r.start_s, r.end_s) for r in intervals.union(df, keys).collect()) == [(1.0, 5.0), (6.0, 7.0)]
    assert sorted((r.start_s, r.end_s) for r in intervals.merge_overlapping(df, keys).collect()) == [(1.0, 3.0), (3.0, 5.0), (6.0, 7.0)]
    assert [r.event_id for r in events.merged(df).orderBy("start_s").collect()] == ["e001", "e002", "e003"]


def test_half_open_activity(spark):
    spans = spark.createDataFrame([("c", 1.0, 3.0), ("c", 5.0, 6.0)], "clip_id string, start_s double, end_s double")
    instants = spark.createDataFrame([("c", t) for t in (1.0, 3.0, 4.0, 5.0)], "clip_id string, t double")
    assert sorted(r.t for r in intervals.active_at(instants, spans, ["clip_id"]).collect()) == [1.0, 5.0]


def test_occupancy_of_parallel_events(spark):
    rows = [("c", 0, "e", "p", "v", 0, 0.0, 4.0), ("c", 1, "e", "p", "v", 0, 2.0, 5.0), ("c", 2, "e", "q", "w", 1, 3.0, 6.0)]
    r = intervals.pooled(intervals.occupancy(spark.createDataFrame(rows, SPANS), ["clip_id"]), ["clip_id"]).where("clip_id IS NULL").first()
    assert (r.predicted, r.reference, r.shared, r.iou) == (5.0, 3.0, 2.0, round(1 / 3, 6))


def test_undefined_rates_are_null(spark):
    zero = F.lit(0)
    row = spark.range(1).select(*[v.alias(k) for k, v in evaluation.rates(zero, zero, zero, F.lit(0.0)).items()]).first()
    assert list(row) == [None] * 4


def test_assignment_is_best():
    rng = random.Random(3)
    for _ in range(400):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        pairs = [(i * 10, j, rng.choice([rng.random(), 0.5])) for i in range(n) for j in range(m) if rng.random() < 0.6] or [(0, 0, 0.4)]
        rng.shuffle(pairs)
        left, right, value = (np.array(x) for x in zip(*pairs, strict=True))
        taken = evaluation.assignment(left, right, value)
        assert len(set(left[taken])) == len(set(right[taken])) == len(taken)
        w = {(a, b): v for a, b, v in pairs}
        small, large, key = (set(left), [*set(right), *[None] * n], lambda a, b: (a, b)) if n <= m else (set(right), [*set(left), *[None] * m], lambda a, b: (b, a))
        tries = ([w[key(a, b)] for a, b in zip(small, p, strict=True) if key(a, b) in w] for p in itertools.permutations(large, len(small)) if len(large) <= 7)
        best = max(((len(t), sum(t)) for t in tries), default=None)
        if best:
            assert (len(taken), value[taken].sum()) == pytest.approx(best)


def test_assignment_of_a_large_component_is_optimal():
    """Against a sweep that is exact for points on a line."""
    rng = np.random.default_rng(4)
    a, b = np.sort(rng.random(400)) * 400, np.sort(rng.random(420)) * 400
    left, right = np.nonzero(np.abs(a[:, None] - b[None]) < 4)
    value = 1 - np.abs(a[left] - b[right]) / 5
    taken = evaluation.assignment(left, right, value)
    table = np.full((401, 421), -np.inf)
    table[0, :] = table[:, 0] = 0.0
    known = {(i, j): v for i, j, v in zip(left, right, value, strict=True)}
    for i in range(400):
        for j in range(420):
            table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + 1000 + known[i, j] if (i, j) in known else -np.inf)
    assert 1000 * len(taken) + value[taken].sum() == pytest.approx(table[-1, -1])


def test_components_of_long_chains_and_stars(spark):
    n = 600
    rows = [("a", i, i + 1) for i in range(n)] + [("b", 5000, i) for i in range(900)] + [("b", 7, 7), ("c", 3, 2), ("c", 2, 3)]
    got = {(r.k, r.node): r.root for r in graph.components(spark.createDataFrame(rows, "k string, a long, b long"), ["k"]).collect()}
    assert got == {**{("a", i): 0 for i in range(n + 1)}, **{("b", i): 0 for i in [*range(900), 5000]}, ("c", 2): 2, ("c", 3): 2}


def test_one_clip_is_matched_in_many_pieces(spark):
    rng = random.Random(2)
    spans = [("a", 2 * i + s, s, 100.0 * (i // 3) + rng.random() * 20, 100.0 * (i // 3) + 30 + rng.random() * 30, "x") for i in range(300) for s in (0, 1)]
    df = spark.createDataFrame(spans, "clip_id string, event_id long, side int, start_s double, end_s double, type string")
    found = evaluation.match(evaluation.match_candidates(df, ["clip_id"], 0.1), ["clip_id"]).collect()
    assert len(found) == 300 and len({r.event_id for r in found}) == len({r.r_event_id for r in found}) == 300
    for block in range(0, 300, 60):
        at = lambda r: (r.event_id // 2) // 3 == block // 3
        own = {(r.event_id, r.r_event_id): r.tiou for r in evaluation.match_candidates(df, ["clip_id"], 0.1).where(f"event_id div 6 = {block // 3}").collect()}
        left, right = sorted({a for a, _ in own}), sorted({b for _, b in own})
        best = max(sum(own[a, b] for a, b in zip(left, p, strict=True)) for p in itertools.permutations(right) if all((a, b) in own for a, b in zip(left, p, strict=True)))
        assert sum(r.tiou for r in found if at(r)) == pytest.approx(best)


#: Side, clip, type, start and end of a labelled evaluation set, and the clips' seconds.
PREDICTED = [
    ("a", "other_interaction", 1.7666666666666666, 5.966666666666667), ("b", "enter", 0.28, 3.0), ("b", "enter", 3.48, 4.56), ("b", "load_unload", 4.4, 6.08), ("b", "other_interaction", 4.6, 5.32),
    ("n1", "exit", 1.8333333333333333, 6.833333333333333), ("n1", "enter", 9.0, 14.0), ("n1", "enter", 13.0, 14.5), ("n6", "exit", 0.0, 8.333333333333334),
    ("i", "enter", 0.0, 2.6998650067496626), ("i", "load_unload", 6.149692515374231, 6.899655017249137), ("i", "other_interaction", 15.899205039748013, 17.399130043497824), ("i", "load_unload", 16.499175041247938, 24.14879256037198),
    ("i", "enter", 22.94885255737213, 23.69881505924704), ("i", "enter", 25.948702564871756, 26.698665066746663), ("i", "exit", 17.799010049497525, 20.049010049497525), ("m0", "enter", 9.4094, 9.976633333333334), ("m1", "enter", 3.8371666666666666, 6.673333333333333),
]
REFERENCE = [
    ("b", "enter", 3.8, 4.44), ("b", "exit", 0.0, 1.2), ("b", "other_interaction", 1.2, 6.12), ("i", "load_unload", 3.749813, 15.59922), ("i", "load_unload", 17.549123, 24.148793), ("i", "exit", 16.049198, 19.649018), ("i", "exit", 0.0, 1.049948),
    ("m0", "enter", 9.476133, 9.976633), ("m1", "enter", 5.4054, 6.673333), ("n1", "exit", 0.0, 4.166667), ("n1", "enter", 11.0, 16.333333), ("n1", "exit", 11.666667, 12.833333), ("n6", "exit", 0.0, 4.0), ("a", "other_interaction", 0.0, 8.8),
]
EXPECTED = {(0.15, False): (13, 5, 1), (0.15, True): (9, 9, 5), (0.3, False): (12, 6, 2), (0.3, True): (9, 9, 5), (0.5, False): (3, 15, 11), (0.5, True): (3, 15, 11), (0.7, False): (2, 16, 12), (0.7, True): (2, 16, 12)}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(c, n, t, "p", "v", side, s, e) for side, part in ((0, PREDICTED), (1, REFERENCE)) for n, (c, t, s, e) in enumerate(part, 100 * side)]
    return spark.createDataFrame(rows, SPANS)


def test_published_counts(labelled):
    grid = reports.metric_grid(labelled, ["clip_id"], (0.15, 0.3, 0.5, 0.7)).collect()
    assert {(r.threshold, r.typed): (r.tp, r.fp, r.fn) for r in grid} == EXPECTED
    first = next(r for r in grid if r.threshold == 0.15 and not r.typed)
    assert (first.precision, first.recall, first.f1) == (0.7222, 0.9286, 0.8125)
    assert [round(x, 3) for x in (first.start_median, first.start_p90, first.end_median, first.end_p90)] == [1.568, 2.533, 1.167, 2.8]


def test_published_occupancy(labelled):
    r = intervals.pooled(intervals.occupancy(labelled, ["clip_id"]), ["clip_id"]).where("clip_id IS NULL").first()
    assert (r.shared, r.predicted, r.reference, r.union_s) == (31.021, 44.206, 51.187, 64.372)
    assert [round(x, 4) for x in (r.precision, r.recall, r.iou, r.f1)] == [0.7017, 0.606, 0.4819, 0.6504]


def test_dashboard_is_html(labelled):
    page = reports.dashboard(labelled, ["clip_id"], (0.3,))
    assert page.count("<table>") == 3 and "false_alarm" in page


def test_coverage_and_encounters(spark):
    gt = spark.createDataFrame([("c", 1, "e", "p", "v", 1, 1.0, 3.0)], SPANS)
    other = spark.createDataFrame([("c", 2, "e", "wrong", "v", 0, 1.0, 3.0)], SPANS)
    right = spark.createDataFrame([("c", 3, "e", "p", "v", 0, 1.0, 2.0), ("c", 4, "e", "p", "v", 0, 1.5, 2.0)], SPANS)
    keys = ["clip_id", "person_id", "vehicle_id"]
    assert evaluation.coverage(other, gt, keys).first().covered == 0
    assert evaluation.coverage(right, gt, keys).first().covered == 1
    assert tuple(evaluation.encounters_hit(gt, right, keys).first()) == (1, 1)


def test_collapsed_episodes(spark):
    one = spark.createDataFrame([("c", "enter", "p", "v", 1.0, 4.0), ("c", "exit", "p", "v", 1.2, 3.8)], EVENTS)
    two = spark.createDataFrame([("c", "exit", "p", "v", 0.0, 1.0), ("c", "enter", "p", "v", 3.0, 4.0)], EVENTS)
    assert [r.type for r in events.collapsed(one).collect()] == ["other_interaction"]
    assert events.collapsed(two).count() == 2


def test_the_metric_grid_is_what_single_matchings_give(spark):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        start = rng.randrange(60)
        rows.append((rng.choice(["a", "b", "only predicted"]) if i % 2 == 0 else rng.choice(["a", "b", "only referred"]), i, rng.choice(["enter", "exit", "load"]), i % 2, float(start), float(start + rng.randrange(1, 12))))
    df = graph.reliable(spark.createDataFrame(rows, "clip_id string, event_id long, type string, side int, start_s double, end_s double"))
    got = {(r.threshold, r.typed, r.clip_id, r.type): r for r in evaluation.metric_grid(df, ["clip_id"], (0.3, 0.6)).collect()}
    for threshold in (0.3, 0.6):
        for typed in (False, True):
            matched = graph.reliable(evaluation.match(evaluation.match_candidates(df, ["clip_id"], threshold, typed), ["clip_id"]))
            per = {r.clip_id: (r.tp, r.fp, r.fn) for r in evaluation.counts(df, matched, ["clip_id"]).collect()}
            assert set(per) == {k[2] for k in got if k[:2] == (threshold, typed) and k[2]} == {"a", "b", "only referred"}
            for clip, counts in per.items():
                r = got[threshold, typed, clip, None]
                assert (r.tp, r.fp, r.fn) == counts and r.start_median is None
            whole, errors = got[threshold, typed, None, None], evaluation.boundary_errors(matched).first()
            assert (whole.tp, whole.fp, whole.fn) == tuple(map(sum, zip(*per.values(), strict=True)))
            assert whole.tp == errors.n
            types = {k[3]: r for k, r in got.items() if k[:2] == (threshold, typed) and k[3]}
            assert bool(types) == typed and (not typed or sum(r.tp for r in types.values()) == whole.tp)
    one = {k for k in got if k[2] is None and k[3] is None}
    assert len(one) == 4


def test_an_episode_is_told_by_its_winning_type(spark):
    schema = EVENTS + ", evidence array<int>, truncated_start boolean, truncated_end boolean, person_description string, vehicle_description string"
    rows = [
        ("c", "enter", "p", "v", 0.0, 5.0, [3, 1], False, None, "long", "red"), ("c", "other_interaction", "q", "v", 0.5, 4.9, [2], True, False, "right", "blue"), ("c", "other_interaction", "r", "v", 0.4, 4.0, [2], False, False, "short", None),
        ("c", "exit", "p", "w", 0.0, 2.0, [9], False, False, "a", "x"), ("c", "enter", "q", "w", 0.1, 2.0, [8], False, True, "b", "y"),
        ("d", "exit", "p", "v", 0.0, 4.0, [1], False, False, "one", "car"), ("d", "exit", "p", "v", 3.9, 9.0, [2], False, True, "two", "van"),
    ]
    got = {(r.clip_id, r.vehicle_id): r for r in events.collapsed(spark.createDataFrame(rows, schema)).collect()}
    a, b, d = got["c", "v"], got["c", "w"], got["d", "v"]
    assert (a.type, a.person_id, a.person_description, a.vehicle_description, a.start_s, a.end_s, a.n_events, a.evidence, a.truncated_start, a.truncated_end) == ("other_interaction", "q", "right", "red", 0.0, 5.0, 3, [1, 2, 3], True, False)
    assert (b.type, b.person_id, b.person_description, b.truncated_end) == ("other_interaction", "p", "a", True)
    # too little in common for one episode, but of one pair and overlapping: merged in the end
    assert (d.type, d.start_s, d.end_s, d.n_events, d.person_description, d.vehicle_description, d.truncated_end) == ("exit", 0.0, 9.0, 2, "one", "car", True)
    kept = events.merged(spark.createDataFrame(rows[-2:], schema)).first()
    assert (kept.event_id, kept.person_description, kept.evidence, kept.truncated_end) == ("e001", "one", [1, 2], True)


def test_tracks_are_cut_where_they_turn_into_others(spark):
    boxes = spark.createDataFrame([("c", f, i) for f in range(6) for i in (7, 8)] + [("d", 9, 7)], "clip_id string, frame_index int, id int")
    turns = spark.createDataFrame([("c", 7, 2), ("c", 7, 4), ("c", 99, 0)], "clip_id string, id int, at_frame int")
    got = events.split_tracks(boxes, turns, ["clip_id"])
    assert {(r.clip_id, r.frame_index, r.raw_id): r.id for r in got.collect()} == {("c", f, i): i if i == "8" or f < 2 else "7b" if f < 4 else "7c" for f in range(6) for i in ("7", "8")} | {("d", 9, "7"): "7"}
    assert events.split_tracks(got, turns.withColumn("id", F.lit("7c")).limit(1), ["clip_id"]).where("id <> raw_id").select("raw_id").distinct().count() == 1


def test_episodes_need_people_together(spark):
    rows = [(n, p) for n in ("p", "q") for p in (0, 1)]
    near = [box(i, float(i), n, 10 * (n == "q"), 0, 20 + 10 * (n == "q"), 50, kind="person") for n, i in rows] + [box(i, float(i), "v", 0, 0, 90, 60) for i in (0, 1)]
    far = [b if b[4] != "q" else (*b[:6], b[6] + 500, b[7], b[8] + 500, b[9], b[10]) for b in near]
    e = spark.createDataFrame([("c", "enter", "p", "v", 0.0, 1.0), ("c", "enter", "q", "v", 0.0, 1.0)], EVENTS)
    assert events.collapsed(e, spark.createDataFrame(near, BOX)).count() == 1
    assert events.collapsed(e, spark.createDataFrame(far, BOX)).count() == 2
    twins = [box(0, 0.0, n, 0, 0, 100, 60, kind="car") for n in ("v", "w")] + [box(0, 0.0, "p", 0, 0, 9, 9)]
    other = spark.createDataFrame([("c", "enter", "p", "v", 0.0, 1.0), ("c", "exit", "p", "w", 0.0, 0.9)], EVENTS)
    (got,) = events.collapsed(other, spark.createDataFrame(twins, BOX)).collect()
    assert (got.type, got.vehicle_id, got.n_events) == ("other_interaction", "v", 2)


def test_heads_and_crops(spark):
    schema = "f int, obj string, x1 double, y1 double, x2 double, y2 double"
    heads = spark.createDataFrame([(0, "in", 4.0, 0.0, 6.0, 2.0), (0, "free", 50.0, 0.0, 52.0, 2.0), (0, "huge", 80.0, 0.0, 105.0, 30.0)], schema)
    people = spark.createDataFrame([(0, "p", 0.0, 0.0, 10.0, 30.0)], schema)
    vehicles = spark.createDataFrame([(0, "v", 70.0, 0.0, 120.0, 40.0)], schema)
    free = detections.new_heads(heads, people, vehicles, ["f"], widest=0.35)
    assert [r.obj for r in free.collect()] == ["free"]
    assert {r.obj for r in detections.new_heads(heads, people, vehicles, ["f"]).collect()} == {"free", "huge"}
    assert [r.head_obj for r in detections.attributed(people, heads, free, ["f"]).collect()] == ["in"]
    seen = spark.createDataFrame([(0, "t", 48.0, 0.0, 54.0, 14.0), (0, "none", 200.0, 0.0, 210.0, 30.0)], schema)
    assert {r.obj: r.head_obj for r in detections.attributed(seen, heads, free, ["f"]).collect()} == {"t": "free", "none": None}
    crops = spark.createDataFrame([(0, n, m, x, 0.0, x + 10, 10.0) for n, m, x in (("a", 3.0, 0.0), ("b", 2.0, 1.0), ("c", 1.0, 50.0))], "f int, obj string, motion double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(c.obj for c in suppress.motion_crops(crops, ["f"]).collect()) == ["a", "c"]
    assert [f["ts"] for f in detections.time_gate([{"ts": t / 10} for t in range(10)], 4.0)] == [0.0, 0.3, 0.6, 0.9]  # each a quarter of a second after the one before


def test_review_frames_and_render_quality(spark):
    frames = spark.createDataFrame([("c", i, i / 10) for i in range(100)], "clip_id string, frame_index int, ts double")
    spans = spark.createDataFrame([("c", 1.05, 2.0)], "clip_id string, start_s double, end_s double")
    got = {round(r.ts, 1) for r in detections.review_frames(frames.select("clip_id", "ts"), spans, ["clip_id"], 3).collect()}
    assert got == {0.0, 1.0, 1.1, 1.5, 1.6, 1.9, 2.0, 4.9, 9.9}
    drawn = frames.withColumn("active", F.array(F.lit("e1")))
    quality = detections.render_quality(drawn, drawn.withColumn("active", F.when(F.col("frame_index") < 50, F.col("active")).otherwise(F.array(F.lit("e2")))), ["clip_id"]).first()
    assert (quality.frames, quality.agreement, quality.max_time_error) == (100, 0.5, 0.0)


def test_config():
    assert RELEASED.expand_near == 0.25 and DEFAULT.expand_near == 0.35
    assert Config.read('{"window_s": 9}').window_s == 9 and Config.read(RELEASED.json()) == RELEASED
    for bad in ('{"window_s": 1}', '{"sample_frames": 1}', '{"nonsense": 1}'):
        with pytest.raises(ValueError):
            Config.read(bad)


def numbered(spark, rows):
    return events.merged(spark.createDataFrame(rows, EVENTS))


def test_a_walk_along_the_vehicle_is_an_exit(spark):
    rows = [box(i, i * 0.2, "p", x, 0, x + 10, 90) for i, x in enumerate((75, 65, 50, 35, 15, -5))] + [box(i, i * 0.2, "v", 0, 10, 100, 90) for i in range(6)]
    boxes = spark.createDataFrame(rows, BOX)
    got = events.consistent(events.evidence_of(numbered(spark, [("c", "enter", "p", "v", 0.0, 1.0)]), boxes)).first()
    assert got.final_type == "exit"


def test_who_vanishes_at_a_vehicle_has_entered(spark):
    rows = [box(i, i * 0.2, "p", x, 10, x + 20, 90) for i, x in enumerate((0, 35, 70))] + [box(i, i * 0.2, "v", 90, 10, 190, 90) for i in range(7)]
    boxes = spark.createDataFrame(rows, BOX)
    got = events.consistent(events.evidence_of(numbered(spark, [("c", "other_interaction", "p", "v", 0.0, 0.6)]), boxes)).first()
    assert got.final_type == "enter"


def test_visibility_and_labels(spark):
    e = spark.createDataFrame([("c", "door_operation", "p", "v", 0.0, 3.5)], EVENTS)
    seen = spark.createDataFrame([("c", "p", 1.0)], "clip_id string, person_id string, first_seen double")
    got = intervals.cut_to(e, seen, ["clip_id", "person_id"], first="first_seen").select(X.normalized_label(F.col("type")), "start_s", "end_s").first()
    assert tuple(got) == ("load_unload", 1.0, 3.5)


def test_expansion_is_asymmetric():
    frames = [{"ts": round(i * 0.5, 1), "gap": 0.0, "start_s": 20.0, "end_s": 22.0, "duration": 60.0, "event_id": "e"} for i in range(100)]
    (moving,) = plain.expand(frames)
    (fixed,) = plain.expand(frames, symmetric=True)
    assert (moving["start_s"], moving["end_s"]) == (0.0, 24.5)
    assert (fixed["start_s"], fixed["end_s"]) == (18.0, 24.5)
    apart = [f | {"gap": None} for f in frames]
    (still,) = plain.expand(apart)
    assert (still["start_s"], still["end_s"]) == (19.5, 23.0)


def test_expanded_in_spark_equals_the_fold(spark):
    rows = [box(i, round(i * 0.1, 1), "p", 0, 0, 10, 10) for i in range(40)] + [box(i, round(i * 0.1, 1), "v", 5, 0, 30, 20) for i in range(10, 30)]
    boxes = spark.createDataFrame(rows, BOX)
    got = events.expanded(numbered(spark, [("c", "enter", "p", "v", 1.5, 2.0)]), boxes, F.lit(4.0)).first()
    assert (got.start_s, got.end_s) == (0.5, 3.5)


@pytest.mark.parametrize("symmetric", [False, True])
def test_expansion_equals_the_walk(spark, symmetric):
    """Pairs that are close in some frames, frames that lack, and events anywhere, against walking frame by frame."""
    rng = random.Random(5)
    times = sorted({round(rng.uniform(0, 30), 2) for _ in range(160)})
    times = [t for t in times if not 11 < t < 14]  # nothing is seen here
    near = {t for t in times if rng.random() < 0.6}
    rows = [box(i, t, n, *corners) for i, t in enumerate(times) for n, corners in (("p", (0, 0, 10, 10)), ("v", (5, 0, 30, 20) if t in near else (300, 0, 330, 20)))]
    spans = [(s := round(rng.uniform(0, 28), 2), round(s + rng.uniform(0.1, 2), 2)) for _ in range(60)]
    made = spark.createDataFrame([("c", f"e{i}", "enter", "p", "v", a, b) for i, (a, b) in enumerate(spans)], "clip_id string, event_id string, type string, person_id string, vehicle_id string, start_s double, end_s double")
    got = {r.event_id: (r.start_s, r.end_s) for r in events.expanded(made, spark.createDataFrame(rows, BOX), F.lit(31.0), symmetric=symmetric).collect()}
    for i, (a, b) in enumerate(spans):
        frames = [{"ts": t, "gap": 0.0 if t in near else 9.0, "start_s": a, "end_s": b, "duration": 31.0} for t in times]
        (row,) = plain.expand(frames, symmetric=symmetric)
        assert got[f"e{i}"] == pytest.approx((row["start_s"], row["end_s"])), (i, a, b)


def test_the_whole_chain(spark):
    """Two overlapping door operations: merged, expanded over the frames in which the car is near, cut to its presence, labelled."""
    rows = [box(i, round(i * 0.1, 1), "p", 0, 0, 10, 10) for i in range(40)] + [box(i, round(i * 0.1, 1), "v", 5, 0, 30, 20) for i in range(10, 30)]
    made = spark.createDataFrame([("c", "door_operation", "p", "v", 1.5, 2.0, [15]), ("c", "door_operation", "p", "v", 1.8, 2.2, [20, 15])], EVENTS + ", evidence array<int>")
    (r,) = events.assembled(made, spark.createDataFrame(rows, BOX), F.lit(4.0)).collect()
    assert (r.event_id, r.type, r.person_id, r.vehicle_id, r.start_s, r.end_s, list(r.evidence)) == ("e001", "load_unload", "p", "v", 1.0, 2.9, [15, 20])
    (plainly,) = events.assembled(made, spark.createDataFrame(rows, BOX), F.lit(4.0), Config(exclusive_person_vehicle=False)).collect()
    assert (plainly.start_s, plainly.end_s) == (1.5, 2.2)


def test_the_head_tells_separable_classes(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) + 4 * (i % 2)).tolist(), i % 2, i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, fold int")
    best = learning.best_threshold(learning.head_scores(df, [0, 1, 2])).first()
    assert best.f1 == 1.0 and 0.2 <= best.threshold <= 0.8


def test_one_vehicle_at_a_time(spark):
    """The nearer vehicle wins where two events of a person meet; evidence follows, or the nearest frame stands in."""
    rows = []
    for i in range(10):
        x = 10 * i  # from a to b
        rows += [box(i, float(i), "p", x, 0, x + 5, 10), box(i, float(i), "a", 0, 0, 20, 20), box(i, float(i), "b", 80, 0, 100, 20)]
    made = [("c", 1, "p", "a", [(0.0, 8.0)], [1, 7]), ("c", 2, "p", "b", [(2.0, 10.0)], [2, 3]), ("c", 3, "q", "a", [(0.0, 9.0)], [4]), ("c", 4, "p", "a", [(20.0, 21.0)], [1])]
    df = spark.createDataFrame(made, "clip_id string, event_no int, person_id string, vehicle_id string, spans array<struct<start_s:double,end_s:double>>, evidence array<int>")
    got = {r.event_no: ([tuple(s) for s in r.spans], list(r.evidence)) for r in exclusive.single_vehicle(df, spark.createDataFrame(rows, BOX)).collect()}
    assert got == {1: ([(0.0, 5.0)], [1]), 2: ([(5.0, 10.0)], [7]), 3: ([(0.0, 9.0)], [4]), 4: ([(20.0, 21.0)], [9])}


def test_clip_faults(spark):
    rows = [("c", "a", [(1.0, 7.0)], [0]), ("c", "b", [(1.0, 2.0), (1.5, 3.0)], [4]), ("c", "d", [(1.0, 2.0)], [99]), ("c", "d", [(0.0, 1.0)], [0]), ("c", "fine", [(0.0, 1.0), (1.0, 2.0)], [0])]
    df = spark.createDataFrame(rows, "clip_id string, event_id string, spans array<struct<start_s:double,end_s:double>>, evidence_frames array<int>").withColumns({"frame_count": F.lit(10), "duration_s": F.lit(5.0)})
    got = {(r.event_id, tuple(r.faults)) for r in events.faults(df).collect()}
    assert got == {("a", ("past the end",)), ("b", ("order",)), ("d", ("frame", "repeated id")), ("d", ("repeated id",))}


def test_decisions(spark):
    good = '{"decision":"interaction","reason":"r","events":[{"type":"enter","start_frame":0,"end_frame":10,"evidence_frames":[5]}]}'
    answers = [("good", good), ("fence", f"```json\n{good}\n```"), ("list", f"[{good}]"), ("two", f"[{good},{good}]"), ("invented", good.replace("[5]", "[8]")), ("broken", "{"), ("null", None), ("empty", '{"decision":"interaction","reason":"","events":[]}')]
    df = spark.createDataFrame(answers, "candidate_id string, answer string")
    got = {r.candidate_id: (r.decision, list(r.faults)) for r in verify.accepted(df, F.lit([0, 5, 10]).cast("array<bigint>")).collect()}
    assert [k for k, v in got.items() if v[0] == "interaction"] == ["good", "fence", "list"]
    assert got["invented"] == ("uncertain", ["invented"]) and "unreadable" in got["broken"][1] and "unreadable" in got["null"][1] and got["empty"] == ("uncertain", ["events"])
    assert {r.answer[:26] for r in verify.verified(df.drop("answer")).collect()} == {'{"decision": "uncertain", '}


def test_votes_need_a_run(spark):
    vote = lambda k, n, d, t="enter", ev=(1,): (k, n, d, t, list(ev))
    rows = [vote("a", n, "interaction" if n in (1, 2, 3) else "no_interaction") for n in range(5)] + [vote("b", n, "interaction" if n % 2 == 0 else "no_interaction") for n in range(5)] + [vote("c", n, "interaction", ev=()) for n in range(3)]
    df = spark.createDataFrame(rows, "k string, ballot_id int, decision string, type string, evidence_frames array<int>")
    assert {r.k: (r.decision, r.type) for r in verify.tally(df, ["k"]).collect()} == {"a": ("interaction", "enter"), "b": ("no_interaction", None), "c": ("uncertain", None)}


def test_direction(spark):
    rows = [(t, i, t < 2, float(max(0, t - 1)) / 10) for i in ("enter", "other_interaction") for t in range(6)]
    df = spark.createDataFrame([(k, k, float(t), inside, gap) for t, k, inside, gap in rows], "e string, type string, ts double, inside boolean, gap double")
    assert {r.e: r.corrected for r in verify.corrected_direction(df, ["e"]).collect()} == {"enter": "exit", "other_interaction": "other_interaction"}
    half = df.where("type = 'enter'").withColumn("inside", F.col("ts") == 0)  # not inside in all of the first rows
    assert [r.corrected for r in verify.corrected_direction(half, ["e"]).collect()] == ["enter"]
    assert [r.corrected for r in verify.corrected_direction(df.where("type = 'enter' AND ts IN (0, 4, 5)"), ["e"]).collect()] == ["enter"]


def test_an_exit_ends_farther_away(spark):
    gaps = {"grows": (0.0, 0.1, 0.3), "returns": (0.0, 0.3, 0.1), "once": (0.0, 0.5)}
    df = spark.createDataFrame([(k, float(t), t == 0, g) for k, v in gaps.items() for t, g in enumerate(v)], "e string, ts double, inside boolean, gap double")
    assert {r.e for r in verify.exit_cues(df, ["e"]).collect()} == {"grows"}


def test_transition_sampling(spark):
    def sample(visible, count, dense=True):
        df = spark.createDataFrame([("k", i, v) for i, v in enumerate(visible)], "k string, frame_index int, ids string")
        return [r.frame_index for r in emergence.transition_sample(df, ["k"], count, dense=dense).orderBy("frame_index").collect()]

    visible = ["pv" if 4 <= i <= 6 else "v" for i in range(10)]
    assert {0, 9, 4, 7} <= set(sample(visible, 6)) and len(sample(visible, 6)) == 6
    assert sample(visible, 4, dense=False) == [0, 3, 6, 9]
    assert sample([], 4) == [] and sample([""], 8) == [0]


def test_stitching(spark):
    def tracklet(name, frames, start):
        return [box(f, round(f * 0.1, 1), name, x, 10, x + 20, 70) for f, x in zip(frames, start, strict=True)]

    schema = "clip_id string, scene int, id long, first_ts double, last_ts double, first_x double, first_y double, last_x double, last_y double, side double, vx double, vy double, first_vehicle string, last_vehicle string"
    old = ("c", 0, 1, 0.0, 0.1, 20.0, 40.0, 30.0, 40.0, 60.0, 100.0, 0.0, "v1", "v1")
    same, other = (("c", 0, 2, 0.4, 0.5, 60.0, 40.0, 70.0, 40.0, 60.0, 100.0, 0.0, v, v) for v in ("v1", "v2"))
    for new, linked in ((same, 1), (other, 0)):
        links = tracks.greedy_one_to_one(tracks.stitch_candidates(spark.createDataFrame([old, new], schema)), ["clip_id"])
        assert links.count() == linked
    assert len(tracklet("p", (0, 1), (10, 20))) == 2


def test_suppression_is_greedy(spark):
    schema = "frame int, obj string, kind string, x1 double, y1 double, x2 double, y2 double, conf double"
    frame = lambda rows: spark.createDataFrame([(0, n, k, x, y, x2, y2, c) for n, k, x, y, x2, y2, c in rows], schema)
    names = lambda df: sorted(r.obj for r in df.collect())
    chain_ = [(n, "car", x, 0.0, x + 10.0, 10.0, c) for n, x, c in (("a", 0.0, 0.9), ("b", 3.0, 0.8), ("c", 6.0, 0.7))]
    assert names(suppress.suppress(frame(chain_), ["frame"], 0.5)) == ["a", "c"]
    assert names(suppress.united([frame(chain_[:1]), frame(chain_[1:])], ["frame"], 0.5)) == ["a", "c"]
    inner = [("big", "car", 0.0, 0.0, 100.0, 100.0, 0.5), ("in", "truck", 10.0, 10.0, 20.0, 20.0, 0.5), ("p", "person", 10.0, 10.0, 20.0, 20.0, 0.5)]
    assert names(suppress.drop_contained(frame(inner), ["frame"])) == ["big", "p"]


def test_components(spark):
    rng = random.Random(1)
    edges = [("k", rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [("k", 100 + i, 101 + i) for i in range(40)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for _, a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = graph.components(spark.createDataFrame(edges, "k string, a long, b long"), ["k"]).collect()
    assert {r.node: r.root for r in got} == {n: find(n) for n in parent}


def test_as_of_ties_go_to_the_earlier(spark):
    left = spark.createDataFrame([("c", 1.0), ("c", 2.4), ("d", 1.0)], "k string, t double")
    right = spark.createDataFrame([("c", 0.0, "a"), ("c", 2.0, "b")], "k string, u double, name string")
    get = lambda how: {(r.k, r.t): r.name for r in tracks.as_of(left, right, ["k"], "t", "u", how).collect()}
    assert get("nearest") == {("c", 1.0): "a", ("c", 2.4): "b", ("d", 1.0): None}
    assert get("forward") == {("c", 1.0): "b", ("c", 2.4): None, ("d", 1.0): None}
    assert get("backward") == {("c", 1.0): "a", ("c", 2.4): "b", ("d", 1.0): None}


def test_appearance_change(spark):
    a, b = [0.9, 0.1, 0.0], [0.0, 0.1, 0.9]
    rows = [("t", i, 1.0, a if i < 4 else b) for i in range(9)] + [("u", i, 1.0, a) for i in range(9)]
    got = events.appearance_splits(spark.createDataFrame(rows, "k string, frame_index int, area double, f array<double>"), ["k"]).collect()
    assert [(r.k, r.at_frame) for r in got] == [("t", 4)]


def test_chain_follows_the_motion(spark):
    """A person who is seen once beside a car, then detected going away from it, growing; a larger box off the way is not followed."""
    person = lambda f: (10.0 * f, 0.0, 10.0 * f + 6 + 4 * f, 20.0 + 8 * f, 0.9)
    boxes = [("c", f, f / 10, 7, "car", 0.0, 0.0, 40.0, 30.0, 0.9) for f in range(8)] + [("c", 0, 0.0, 1, "person", *person(0))]
    seen = [("c", f, *person(f)) for f in range(1, 6)] + [("c", 3, 200.0, 0.0, 300.0, 90.0, 0.9)]
    tracked = spark.createDataFrame(boxes, "clip_id string, frame_index int, ts double, id long, kind string, x1 double, y1 double, x2 double, y2 double, conf double")
    detections = spark.createDataFrame(seen, "clip_id string, frame_index int, x1 double, y1 double, x2 double, y2 double, conf double")
    (cue,) = emergence.emergence(tracked, detections).collect()
    assert (cue.person_id, cue.vehicle_id, list(cue.frames)) == (1, 7, [0, 1, 2, 3, 4, 5]) and cue.start_s == 0 and cue.end_s == 0.5
    cues = emergence.emergence(tracked, detections)
    full = emergence.with_chains(tracked.withColumn("scene", F.lit(0)), cues)
    assert full.where("id = 1").count() == 6 and full.where("id = 7").count() == 8
    made = spark.createDataFrame([("c", "enter", 1, 7, 0.4, 0.6, [4]), ("c", "enter", 1, 8, 0.0, 0.5, [1])], "clip_id string, type string, person_id long, vehicle_id long, start_s double, end_s double, evidence array<int>")
    assert emergence.with_exits(made, cues).count() == 2
    (new,) = emergence.with_exits(made.where("vehicle_id = 8"), cues).where("type = 'exit'").collect()
    assert (new.vehicle_id, new.start_s, new.end_s, list(new.evidence)) == (7, 0.0, 0.5, [0, 1, 2, 3, 4, 5])
    copies = tracked.unionByName(spark.createDataFrame([("c", f, f / 10, 2, "person", *person(f)) for f in (2, 3)], tracked.schema))
    assert emergence.emergence(copies, detections).collect() == []  # somebody who is tracked already
    assert emergence.emergence(tracked, detections.where("frame_index < 2")).collect() == []


def test_diverse_sample_is_farthest_first(spark):
    x = np.random.default_rng(4).normal(size=(40, 6)) + 2
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x - x.mean(axis=0)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    expected = [int(np.argmax(np.linalg.norm(u - u.mean(axis=0), axis=1)))]
    while len(expected) < 5:
        expected.append(int(np.argmax(np.min([np.linalg.norm(u - u[e], axis=1) for e in expected], axis=0))))
    assert learning.diverse_sample(rows, 5) == expected


def test_even_positions(spark):
    many = spark.range(1, 60).select(F.col("id").alias("n")).withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
    for k in (1, 2, 7, 20):
        got = many.where(verify.evenly(F.col("i"), F.col("n"), k)).groupBy("n").agg(F.sort_array(F.collect_list("i")).alias("at")).collect()
        assert all(r["at"] == sorted({j * (r.n - 1) // (k - 1) if k > 1 else 0 for j in range(k)}) for r in got)


def test_training_labels(spark):
    schema = "clip_id string, candidate_id string, start_s double, end_s double"
    candidates = spark.createDataFrame([("c", "half", 0.0, 2.0), ("c", "less", 0.0, 1.5), ("c", "unsure", 8.0, 9.0), ("d", "other", 0.0, 9.0), (None, "none", 0.0, 9.0)], schema)
    references = spark.createDataFrame([("c", 1.0, 3.0)], "clip_id string, start_s double, end_s double")
    unsure = spark.createDataFrame([("c", 8.5, 10.0), ("c", 2.0, 4.0)], "clip_id string, start_s double, end_s double")
    assert {r.candidate_id: r.label for r in learning.labelled(candidates, references, ["clip_id"]).collect()} == {"half": 1, "less": 0, "unsure": 0, "other": 0, "none": 0}
    assert {r.candidate_id for r in learning.without_uncertain(candidates, unsure, ["clip_id"]).collect()} == {"half", "less", "other", "none"}


def test_labels_make_no_pairs_of_a_clip(spark):
    """Against every pair, also of spans of no length and reversed ones, and with no join on the clip alone."""
    draw = random.Random(3)
    spans = lambda n: [("a" if i % 9 else "b" if i % 2 else None, i, s := float(draw.randrange(5000)), s + draw.choice([-5.0, 0.0, 10.0, 300.0, 900.0, 4000.0])) for i in range(n)]
    schema = "clip_id string, candidate_id long, start_s double, end_s double"
    some, others = spans(150), spans(12)
    df, r = spark.createDataFrame(some, schema), spark.createDataFrame(others, schema)
    shared = lambda c, o: max(min(c[3], o[3]) - max(c[2], o[2]), 0.0) if c[0] and c[0] == o[0] else -1.0
    kept = learning.without_uncertain(df, r, ["clip_id"])
    assert {x.candidate_id for x in kept.collect()} == {c[1] for c in some if all(shared(c, o) <= 0 for o in others)}
    for refs in (others, [o for o in others if o[2] < o[3]]):
        got = learning.labelled(df, spark.createDataFrame(refs, schema), ["clip_id"])
        assert {x.candidate_id: x.label for x in got.collect()} == {c[1]: int(any(c[0] == o[0] and c[0] and shared(c, o) >= 0.5 * (o[3] - o[2]) for o in refs)) for c in some}
        plans = got._jdf.queryExecution().optimizedPlan().toString() + kept._jdf.queryExecution().optimizedPlan().toString()
        assert "_bucket" in plans and "LeftAnti" not in plans


def test_an_appearance_change_needs_a_vehicle(spark):
    tracks_ = [("p", i, 10.0, [0.9, 0.1] if i < 4 else [0.1, 0.9], near) for i in range(8) for near in [False]] + [("q", i, 10.0, [9.0, 1.0] if i < 4 else [1.0, 9.0], i == 4) for i in range(8)]
    rows = spark.createDataFrame(tracks_, "id string, frame_index int, area double, f array<double>, near boolean")
    assert [(r.id, r.at_frame) for r in events.appearance_splits(rows, ["id"]).collect()] == [("q", 4)]
    assert {r.id for r in events.appearance_splits(rows.drop("near"), ["id"]).collect()} == {"p", "q"}
