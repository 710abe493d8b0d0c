"""Detections become tracks: on known scenes, and on a stream as in batch."""

import datetime as dt
import random

from stie.streaming import tracking
from stie.streaming.tracking import Linking

SCHEMA = "clip_id string, frame_index long, at timestamp, scene long, kind string, x1 double, y1 double, x2 double, y2 double, conf double"
START = dt.datetime(2024, 1, 1)


def seen(frame, x, y=0.0, kind="person", scene=0, clip="c", size=20.0, conf=0.8):
    at = START + dt.timedelta(milliseconds=100 * frame)
    return (clip, frame, at, scene, kind, *((None,) * 5 if x is None else (float(x), float(y), x + size, y + 2 * size, conf)))


def tracks(spark, rows, linking=Linking()):
    return sorted((r.clip_id, r.frame_index, r.id, r.x1, r.observed, r.conf) for r in tracking.linked(spark.createDataFrame(rows, SCHEMA), linking).collect())


def test_crossing_people_keep_their_ids(spark):
    rows = [seen(f, 10.0 * f, 0.0) for f in range(12)] + [seen(f, 110 - 10.0 * f, 14.0) for f in range(12)]
    found = {}
    for _, frame, name, x, observed, _ in tracks(spark, rows):
        assert observed
        found.setdefault(name, []).append((frame, x))
    assert sorted(v[-1][1] - v[0][1] for v in found.values()) == [-110.0, 110.0]


def test_the_missed_are_carried_on_and_forgotten(spark):
    rows = [seen(0, 0.0), seen(1, 5.0), *(seen(f, None) for f in range(2, 5)), seen(5, 25.0), *(seen(f, None) for f in range(6, 30)), seen(30, 150.0)]
    got = tracks(spark, rows)
    carried = {f: (x, c) for _, f, n, x, observed, c in got if not observed}
    assert carried[2] == (10.0, 0.68) and carried[4][0] == 20.0 and 5 not in carried
    assert max(carried) == 17 and {n for _, f, n, *_ in got if f == 30} == {2}
    assert {n for _, f, n, *_ in got if f <= 17} == {1}


def test_cuts_kinds_and_places_taken(spark):
    cut = tracks(spark, [seen(0, 0.0), seen(1, 0.0, scene=1), seen(0, 0.0, kind="car", clip="d"), seen(1, 1.0, clip="d")])
    assert [(c, f, n) for c, f, n, *_ in cut] == [("c", 0, 1), ("c", 1, 2), ("d", 0, 1), ("d", 1, 2)]
    taken = tracks(spark, [seen(0, 0.0), seen(0, 22.0), seen(1, 12.0, size=20.0)], Linking(reach=0.9, taken=0.1))
    assert [(f, observed) for _, f, _, _, observed, _ in taken] == [(0, True), (0, True), (1, True)]
    assert tracks(spark, []) == []


def scenes(seed):
    rng = random.Random(seed)
    rows = []
    for clip in "abc":
        at = [(rng.uniform(0, 400), rng.uniform(-6, 6)) for _ in range(4)]
        for frame in range(40):
            here = [seen(frame, round(x + v * frame, 1), 60.0 * i, rng.choice(["person"] * 9 + ["car"]), frame // 25, clip, conf=round(rng.random(), 2)) for i, (x, v) in enumerate(at) if rng.random() < 0.75]
            rows += here or [seen(frame, None, scene=frame // 25, clip=clip)]
    return rows


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = scenes(3)
    late = [seen(5, 999.0, clip="a")]  # comes when its frame has long been worked on
    parts = [[r for r in rows if r[1] < 15], [r for r in rows if 15 <= r[1] < 28], [r for r in rows if r[1] >= 28] + late, [seen(10_000, 0.0, clip="z")], [seen(20_000, 0.0, clip="z")]]
    for i, part in enumerate(parts):
        random.Random(i).shuffle(part)
    before = {k: spark.conf.get(k, None) for k in tracking.STORE}
    for k, v in tracking.STORE.items():
        spark.conf.set(k, v)
    try:
        for i, part in enumerate(parts):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            query = tracking.live(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "1 second").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination(180)  # each part is a run of its own that goes on from the last one's state
            assert not query.isActive
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    key = lambda r: (r.clip_id, r.frame_index, r.id, r.kind, r.x1, r.y1, r.conf, r.observed)
    got = sorted(key(r) for r in spark.read.parquet(f"{tmp_path}/out").where("clip_id <> 'z'").collect())
    expected = sorted(key(r) for r in tracking.linked(spark.createDataFrame(rows, SCHEMA)).collect())
    assert len(expected) > 300 and got == expected


def test_batches_of_rows_dont_cut_frames(spark):
    rows = scenes(8)
    whole = tracks(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert tracks(spark, rows) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
