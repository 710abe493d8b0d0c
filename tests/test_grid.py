"""The grid join against all pairs of a frame."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stie.functions import geometry as G
from stie.operators import grid, tracks

SCHEMA = "clip_id string, frame_index int, id long, kind string, x1 double, y1 double, x2 double, y2 double"


def boxes(seed):
    rng = random.Random(seed)
    rows = []
    for frame in range(6):
        size = [3, 40, 120, 60, 90, 25][frame]
        for n in range(size):
            w, h = rng.choice([(1, 1), (20, 50), (100, 60), (400, 300)]) if frame == 3 else (rng.choice([16, 32, 64]), rng.choice([16, 32, 48]))
            x, y = (rng.randrange(0, 1024, 16) for _ in range(2)) if frame != 4 else (0.1 * rng.randrange(-3000, 3000), 0.1 * rng.randrange(50))
            rows.append(("a", frame, n, rng.choice(["person", "car", "truck"]), float(x), float(y), float(x + w), float(y + h)))
    rows += [("a", 2, 900, "car", None, 0.0, 1.0, 1.0), ("a", 2, 901, "person", 5.0, 5.0, None, 9.0), ("a", 2, 902, "car", -1e12, 0.0, -1e12 + 5, 9.0), ("a", 1, 903, "person", 90.0, 90.0, 20.0, 20.0), ("a", 2, 904, "person", 3.0, 3.0, 3.0, 3.0), ("b", None, 1, "person", 0.0, 0.0, 1.0, 1.0)]
    return rows + rows[50:53]


def plain(rows, near, left, right):
    for a in rows:
        for b in rows:
            if a[1] is not None and a[:2] == b[:2] and left(a) and right(b) and None not in a[4:] + b[4:] and near(a, b):
                yield a[1], a[2], b[2]


def gap(a, b):
    dx, dy = max(a[4] - b[6], b[4] - a[6], 0.0), max(a[5] - b[7], b[5] - a[7], 0.0)
    return math.sqrt(dx * dx + dy * dy)


def side(b):
    return max(b[6] - b[4], b[7] - b[5])


@pytest.mark.parametrize("margin", [0.0, 0.2, 0.5, 3.0])
def test_same_pairs_as_all_pairs(spark, margin):
    rows = boxes(int(10 * margin))
    df = spark.createDataFrame(rows, SCHEMA)
    found = tracks.near_pairs(df, tracks.FRAME, margin).select("frame_index", "p_id", "v_id")
    expected = sorted(plain(rows, lambda a, b: gap(a, b) <= side(b) * margin, lambda a: a[3] == "person", lambda b: b[3] != "person"))
    assert sorted(map(tuple, found.collect())) == expected and expected
    assert sorted(map(tuple, tracks.near_pairs(df, tracks.FRAME, margin, crowded=False).select("frame_index", "p_id", "v_id").collect())) == expected


def test_one_object_on_both_sides(spark):
    rows = boxes(3)
    met = grid.meeting(spark.createDataFrame(rows, SCHEMA), tracks.FRAME, F.lit(True), F.lit(True), F.lit(0.0), (F.col("a_id") < F.col("b_id")) & (G.gap(G.Box.of("a_"), G.Box.of("b_")) <= 0), ("a_", "b_"))
    assert sorted(map(tuple, met.select("frame_index", "a_id", "b_id").collect())) == sorted(plain(rows, lambda a, b: a[2] < b[2] and gap(a, b) <= 0, lambda _: True, lambda _: True))


def test_few_pairs_are_made(spark):
    """A large frame of small boxes: what meets by cell is a small multiple of what is near."""
    n = 4000
    rng = random.Random(1)
    at = [(rng.randrange(8000), rng.randrange(8000)) for _ in range(n)]
    df = spark.createDataFrame([("a", 1, i, "person" if i % 2 else "car", float(x), float(y), float(x + 60), float(y + 60)) for i, (x, y) in enumerate(at)], SCHEMA)
    kept = tracks.near_pairs(df, tracks.FRAME, 0.2).count()
    laid = grid.meeting(df, tracks.FRAME, F.col("kind") == "person", F.col("kind") != "person", G.Box.of().side * 0.2, F.lit(True)).count()
    assert 0 < kept <= laid <= 5 * kept
