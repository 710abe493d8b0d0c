"""Detections of frames linked to tracks, on streams and in batch, by one and the same step.

A track is expected where its last box and velocity lead. Detections of a frame are given to tracks one to one, as many as
lie within reach and then as close as possible; others begin tracks. A person that is missed is carried on for up to `most` frames with a
confidence that decays, unless somebody is seen there, and stops being carried on when seen again. A cut (another scene) ends all tracks of a clip.

On a stream, detections wait in the state until the watermark has passed their frame: an event-time timer then works on the
frame, so results hang on event times and not on how rows arrive. The state of a clip is its live tracks, an entry each, and
the detections of the frames that the watermark hasn't passed: it is bounded by `most` and by the watermark's delay. Rows of frames that were
worked on are late and are dropped.

detections: clip_id, frame_index, at (timestamp), scene, kind, x1, y1, x2, y2, conf. A frame in which nothing is detected is a row without a box.
The session needs the RocksDB state store (see STORE) for streams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stie.operators.evaluation import assignment

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
CORNERS = ["x1", "y1", "x2", "y2"]
LINKED = "clip_id string, frame_index long, id long, kind string, x1 double, y1 double, x2 double, y2 double, conf double, observed boolean"
TRACK = "kind string, x1 double, y1 double, x2 double, y2 double, vx double, vy double, conf double, seen long"
HELD = "frame_index long, at_ms long, scene long, kind string, x1 double, y1 double, x2 double, y2 double, conf double"


@dataclass(frozen=True)
class Linking:
    """reach: how far, in sides of the expected box, a detection may lie from it; most: frames that a track outlives its last sighting; decay: of its confidence a frame; taken: IoU from which somebody else is there."""

    reach: float = 1.0
    most: int = 12
    decay: float = 0.85
    taken: float = 0.45


def expected(track: tuple, frame: int) -> np.ndarray:
    """The box of a track (see TRACK) in a later frame, at constant velocity."""
    step = frame - track[8]
    return np.array(track[1:5]) + np.array([track[5], track[6], track[5], track[6]]) * step


def overlap(box: np.ndarray, others: np.ndarray) -> float:
    """The greatest IoU of a box with any of the others."""
    if not len(others):
        return 0.0
    wide = np.minimum(box[2], others[:, 2]) - np.maximum(box[0], others[:, 0])
    high = np.minimum(box[3], others[:, 3]) - np.maximum(box[1], others[:, 1])
    both = np.maximum(wide, 0) * np.maximum(high, 0)
    area = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    return float((both / np.maximum(area(box) + area(others) - both, 1e-6)).max())


def step(tracks: dict[int, tuple], next_id: int, frame: int, kinds: list[str], boxes: np.ndarray, conf: np.ndarray, linking: Linking) -> tuple[list[tuple], int]:
    """What a frame gives: rows (id, kind, box, conf, observed) and the next free id; tracks are changed in place."""
    for name in [n for n, t in tracks.items() if frame - t[8] > linking.most]:
        del tracks[name]
    names, of = sorted(tracks), {}
    if names and len(boxes):
        at = np.array([expected(tracks[n], frame) for n in names])
        side = np.maximum(np.maximum(at[:, 2] - at[:, 0], at[:, 3] - at[:, 1]), 1.0)
        apart = (at[:, None, :2] + at[:, None, 2:]) / 2 - (boxes[None, :, :2] + boxes[None, :, 2:]) / 2
        off = np.hypot(apart[..., 0], apart[..., 1]) / side[:, None]
        same = np.array([tracks[n][0] for n in names])[:, None] == np.array(kinds)[None]
        left, right = np.nonzero(same & (off <= linking.reach))
        if len(left):
            chosen = assignment(left, right, 1 - off[left, right] / linking.reach)
            of = {int(right[e]): names[left[e]] for e in chosen}
    rows = []
    for d, box in enumerate(boxes):
        if d in of:
            name, old = of[d], tracks[of[d]]
            shift = ((box[:2] + box[2:]) / 2 - (np.array(old[1:3]) + np.array(old[3:5])) / 2) / (frame - old[8])
        else:
            name, next_id, shift = next_id, next_id + 1, (0.0, 0.0)
        tracks[name] = (kinds[d], *map(float, box), float(shift[0]), float(shift[1]), float(conf[d]), frame)
        rows.append((name, kinds[d], *map(float, box), float(conf[d]), True))
    people = np.array([b for k, b in zip(kinds, boxes, strict=True) if k == "person"]).reshape(-1, 4)
    for name in names:
        track = tracks[name]
        if track[0] == "person" and track[8] < frame:
            at = expected(track, frame)
            if overlap(at, people) <= linking.taken:
                rows.append((name, "person", *(round(float(x), 2) for x in at), round(max(0.01, track[7] * linking.decay ** (frame - track[8])), 4), False))
    return rows, next_id


def _frames(rows: pd.DataFrame) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """frame, scene, and the detections, in an order that doesn't hang on how they came, frame after frame."""
    for frame, found in rows.sort_values(["frame_index", "kind", *CORNERS, "conf"], kind="stable").groupby("frame_index", sort=True):
        scene = int(found["scene"].iloc[0])
        found = found.dropna(subset=CORNERS)
        yield int(frame), scene, found["kind"].tolist(), found[CORNERS].to_numpy(dtype=float), found["conf"].to_numpy(dtype=float)


def _table(clip: str, out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(clip, *r) for r in out], columns=["clip_id", "frame_index", "id", "kind", *CORNERS, "conf", "observed"])


def linked(detections: DataFrame, linking: Linking = Linking()) -> DataFrame:
    """The tracks of a batch (see LINKED). Clips are dealt and sorted, and a task holds one batch of rows and the live tracks of one clip."""

    def of_stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clip, rest, tracks, next_id, last_scene = None, None, {}, 1, None

        def worked(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal next_id, last_scene
            out = []
            for frame, scene, kinds, boxes, conf in _frames(rows):
                if scene != last_scene:
                    tracks.clear()
                    last_scene = scene
                made, next_id = step(tracks, next_id, frame, kinds, boxes, conf, linking)
                out += [(frame, *r) for r in made]
            return _table(clip, out)

        for batch in batches:
            for name, rows in batch.groupby("clip_id", sort=False):
                if name != clip:
                    if rest is not None:
                        yield worked(rest)
                    clip, rest, next_id, last_scene = name, None, 1, None
                    tracks.clear()
                rows = rows if rest is None else pd.concat([rest, rows])
                newest = rows["frame_index"] == rows["frame_index"].max()  # its other rows may be in the next batch
                if not newest.all():
                    yield worked(rows[~newest])
                rest = rows[newest]
        if rest is not None:
            yield worked(rest)

    return detections.drop("at").repartition("clip_id").sortWithinPartitions("clip_id", "frame_index").mapInPandas(of_stream, LINKED)


class Tracker(StatefulProcessor):
    """linked() on a stream, a clip at a time."""

    def __init__(self, linking: Linking):
        self.linking = linking

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getMapState("tracks", "id long", TRACK)
        self.held = handle.getListState("held", HELD)
        self.clock = handle.getValueState("clock", "next_id long, scene long, done_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done = self.clock.get()[2] if self.clock.exists() else -1
        for batch in rows:
            ms = batch["at"].astype("datetime64[ms]").astype("int64")
            fresh = batch.assign(at_ms=ms)[ms > done]
            for moment in fresh["at_ms"].unique():
                self.handle.registerTimer(int(moment))
            names = HELD.replace(",", "").split()[::2]
            kept = fresh[names].astype(object).where(fresh[names].notna(), None)
            if len(kept):
                self.held.appendList([tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in kept.itertuples(index=False)])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = pd.DataFrame(list(self.held.get()), columns=HELD.replace(",", "").split()[::2])
        ready, rest = held[held["at_ms"] <= due], held[held["at_ms"] > due]
        if not len(ready):
            return iter([])
        next_id, last_scene, _ = self.clock.get() if self.clock.exists() else (1, None, -1)
        tracks = {k[0]: tuple(v) for k, v in self.tracks.iterator()}
        before, out = set(tracks), []
        for frame, scene, kinds, boxes, conf in _frames(ready):
            if scene != last_scene:
                tracks.clear()
                last_scene = scene
            made, next_id = step(tracks, next_id, frame, kinds, boxes, conf, self.linking)
            out += [(frame, *r) for r in made]
        for name in before - set(tracks):
            self.tracks.removeKey((name,))
        for name, track in tracks.items():
            self.tracks.updateValue((name,), track)
        self.held.clear()
        if len(rest):
            kept = rest.astype(object).where(rest.notna(), None)
            self.held.put([tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in kept.itertuples(index=False)])
        self.clock.update((next_id, last_scene, due))
        return iter([_table(key[0], out)])

    def close(self) -> None:
        pass


def live(detections: DataFrame, late: str = "2 seconds", linking: Linking = Linking()) -> DataFrame:
    """The tracks of a stream of detections (see LINKED), frame after frame as the watermark passes them."""
    return detections.withWatermark("at", late).groupBy("clip_id").transformWithStateInPandas(statefulProcessor=Tracker(linking), outputStructType=LINKED, outputMode="Append", timeMode="EventTime")
