import json
import time

import pandas as pd
import pytest

from stie.sources import documents, frames
from stie.streaming import live


@pytest.fixture
def folder(tmp_path):
    event = {"event_id": "e1", "type": "enter", "persons": [{"person_id": "p1", "description": "d"}], "vehicle": {"vehicle_id": "v1", "description": ""}, "spans": [{"start_s": 1.0, "end_s": 2.0}, {"start_s": 3.0, "end_s": 4.0}], "truncated_start": False, "truncated_end": False, "evidence_frames": [3]}
    (tmp_path / "clips").mkdir()
    (tmp_path / "clips/a.json").write_text(json.dumps({"schema_version": "1.0", "clip_id": "a", "status": "ok", "duration_s": 5.0, "frame_count": 10, "interactions": [event], "extra": 1}, indent=1))
    (tmp_path / "tracks").mkdir()
    box = {"id": "p00_001", "kind": "person", "bbox": [1, 2, 3, 4], "confidence": 0.5}
    (tmp_path / "tracks/a.jsonl").write_text("\n".join(json.dumps({"frame_index": i, "timestamp_s": i / 10, "scene": 0, "objects": [box] * i}) for i in range(3)))
    (tmp_path / "truth.json").write_text(json.dumps({"a": {"duration_s": 5.0, "interactions": [event, event]}, "b": {"duration_s": 1.0, "interactions": []}}))
    (tmp_path / "times").mkdir()
    (tmp_path / "times/vfr.txt").write_text("1.0\n1.04\n1.1\n1.14\n1.22")
    return tmp_path


def test_documents(spark, folder):
    clips = documents.read_clips(spark, f"{folder}/clips")
    assert documents.flat_interactions(clips).select("clip_id", "event_id").collect() == [("a", "e1")]
    assert documents.event_spans(clips).count() == 2
    assert [(r.clip_id, r.unknown) for r in documents.unknown_keys(spark, f"{folder}/clips", ["schema_version", "clip_id", "status", "duration_s", "frame_count", "interactions"]).collect()] == [("a", ["extra"])]
    truth = documents.read_map(spark, f"{folder}/truth.json", documents.REFERENCE).select("clip_id", "value.duration_s", "value.interactions")
    assert documents.event_spans(truth).select("event_no", "event_id").distinct().count() == 2
    rows = documents.read_tracks(spark, f"{folder}/tracks").orderBy("frame_index").collect()
    assert [(r.clip_id, r.frame_index, r.x2, r.observed) for r in rows] == [("a", 1, 3.0, True), ("a", 2, 3.0, True), ("a", 2, 3.0, True)]
    documents.write_documents(clips, f"{folder}/out", "clip_id")
    index = documents.deliverable(spark, f"{folder}/clips")
    assert index.count() == 1 and documents.stale(index, index).count() == 0
    assert documents.missing(truth, clips).collect() == [("b",)]
    assert documents.clip_files(spark, f"{folder}/clips", "*.json").first().clip_id == "a"
    with pytest.raises(FileNotFoundError):
        documents.clip_files(spark, f"{folder}/clips", "*.mp4")


def test_frames_and_probe(spark, folder):
    from pyspark.sql import functions as F

    got = frames.read_frames(spark, f"{folder}/times").orderBy("frame_index").collect()
    assert [round(r.ts, 3) for r in got] == [0.0, 0.04, 0.1, 0.14, 0.22]
    df = spark.createDataFrame(got).withColumn("duration", F.lit(None).cast("double"))
    r = documents.probe(df).first()
    assert r.frame_count == 5 and r.duration_s == pytest.approx(0.22 + 0.05)
    (folder / "times/bad.txt").write_text("1.0\n0.9")
    with pytest.raises(Exception, match="not after"):
        frames.read_frames(spark, f"{folder}/times").count()


def test_numbers(spark):
    assert documents.next_number(spark.createDataFrame([("1",), ("4",), ("draft",)], "name string")) == 5
    assert documents.next_number(spark.createDataFrame([("draft",)], "name string")) == 1


def stream_of(spark, folder, rows, schema, build, expected):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/in")
    query = build(spark.readStream.schema(schema).parquet(f"{folder}/in")).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", f"{folder}/ck").start()
    try:  # timeouts by processing time keep the query busy, so wait for the rows and not for it
        for _ in range(120):
            if spark.table("out").count() >= expected or query.exception():
                break
            time.sleep(0.5)
    finally:
        query.stop()
    return spark.sql("SELECT * FROM out").collect()


def test_live_assignments(spark, tmp_path):
    rows = [("c", 1, 0.0, 7, 0.1), ("c", 1, 0.1, 8, 0.10), ("c", 1, 0.1, 7, 0.12), ("c", 1, 0.2, 8, 0.1), ("c", 1, 0.2, 7, 0.3)]
    got = stream_of(spark, tmp_path, rows, "clip_id string, person_id long, ts double, vehicle_id long, rank double", live.assignments, 3)
    assert [(r.ts, r.vehicle_id) for r in sorted(got, key=lambda r: r.ts)] == [(0.0, 7), (0.1, 7), (0.2, 8)]


def test_live_identities(spark, tmp_path):
    rows = [("c", 0, 1, 0.0, 0.0, 10.0, 10.0), ("c", 4, 2, 1.0, 0.0, 11.0, 10.0), ("c", 5, 3, 90.0, 0.0, 99.0, 10.0), ("c", 30, 4, 1.0, 0.0, 11.0, 10.0)]
    got = stream_of(spark, tmp_path, rows, "clip_id string, frame_index long, raw_id long, x1 double, y1 double, x2 double, y2 double", live.identities, 4)
    assert {r.raw_id: r.id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_a_cut_forgets_ids_and_progress_is_counted(spark, tmp_path):
    rows = [("c", 0, 1, 0, 0.0, 0.0, 10.0, 10.0), ("c", 2, 2, 0, 1.0, 0.0, 11.0, 10.0), ("c", 3, 5, 1, 1.0, 0.0, 11.0, 10.0), ("c", 3, 2, 1, 50.0, 0.0, 61.0, 10.0)]
    seen = live.Progress()
    spark.streams.addListener(seen)
    got = stream_of(spark, tmp_path, rows, "clip_id string, frame_index long, raw_id long, scene long, x1 double, y1 double, x2 double, y2 double", live.identities, 4)
    assert {(r.frame_index, r.raw_id): r.id for r in got} == {(0, 1): 1, (2, 2): 1, (3, 5): 5, (3, 2): 2}
    until = time.time() + 20
    while sum(seen.rows.values()) < len(rows) and time.time() < until:
        time.sleep(0.2)
    spark.streams.removeListener(seen)
    assert sum(seen.rows.values()) == len(rows) and not any(seen.late.values())


def test_frames_are_held_until_they_are_whole(spark, tmp_path):
    """The newest frame waits; what comes after its frame has passed is late."""
    ready, held = live._ready(pd.DataFrame({"ts": [0.0, 0.1, 0.2, 0.2]}), "ts", 1, 0.0)
    assert list(ready.ts) == [0.1] and list(held.ts) == [0.2, 0.2]
    ready, held = live._ready(held, "ts", 0, 0.1)
    assert list(ready.ts) == [0.2, 0.2] and not len(held)


def test_propagation(spark):
    rows = [("c", 1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), ("c", 1, 1, 2.0, 0.0, 12.0, 10.0, 0.9), ("c", 1, 4, 8.0, 0.0, 18.0, 10.0, 0.9)]
    got = live.propagated(spark.createDataFrame(rows, "clip_id string, id long, frame_index int, x1 double, y1 double, x2 double, y2 double, conf double")).orderBy("frame_index").collect()
    assert [(r.frame_index, r.x1, r.observed) for r in got] == [(0, 0.0, True), (1, 2.0, True), (2, 4.0, False), (3, 6.0, False), (4, 8.0, True)]
    assert got[2].conf == 0.765
