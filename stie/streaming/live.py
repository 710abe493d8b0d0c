"""The ordered, stateful operators on streams of track rows.

sessions() and counts() close by the watermark. assignments() and identities() keep state by person or
clip: the last choice, the ids seen lately, and the rows of the newest `wait` frames, which are held until
newer frames come or nothing comes for `idle_ms`. With `wait` 0, a frame's rows must come in one
trigger. Rows of a frame that has been passed are late and are dropped. What a state remembers is
bounded by frames, not by the length of the stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(points: DataFrame, keys: list[str], at: str, gap: str, late: str = "10 seconds") -> DataFrame:
    """keys, start, end, n: sessions of points, closed when the watermark has passed them."""
    window = F.session_window(at, gap)
    return points.withWatermark(at, late).groupBy(*keys, window.alias("w")).agg(F.count("*").alias("n"), F.max(at).alias("last")).select(*keys, F.col("w.start").alias("start"), F.col("last").alias("end"), "n")


def counts(points: DataFrame, keys: list[str], at: str, length: str, slide: str, late: str = "10 seconds") -> DataFrame:
    return points.withWatermark(at, late).groupBy(*keys, F.window(at, length, slide).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


ASSIGNED = "clip_id string, person_id long, ts double, vehicle_id long"


def _ready(rows: pd.DataFrame, at: str, wait: int, done: float | None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The rows whose frames can be worked on, and those that are held; late ones are gone."""
    if done is not None:
        rows = rows[rows[at] > done]
    newest = sorted(rows[at].unique())[-wait:] if wait else []
    held = rows[at].isin(newest)
    return rows[~held], rows[held]


def _gathered(batches: Iterator[pd.DataFrame], held: pd.DataFrame) -> pd.DataFrame:
    parts = [x for x in [held, *batches] if len(x)]
    return pd.concat(parts)[held.columns] if parts else held


def assignments(near: DataFrame, max_gap: float = 1.0, switch_margin: float = 0.05, idle_ms: int = 60_000, wait: int = 0) -> DataFrame:
    """One vehicle a frame and person, with hysteresis; near: clip_id, person_id, ts, vehicle_id, rank."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, since, kept_ts, kept_vehicle, kept_rank = state.get if state.exists else (None, None, [], [], [])
        held = pd.DataFrame({"ts": list(kept_ts), "vehicle_id": list(kept_vehicle), "rank": list(kept_rank)})
        ended = state.hasTimedOut
        rows, held = _ready(held if ended else _gathered(batches, held), "ts", 0 if ended else wait, since)
        out = []
        for ts, frame in rows.sort_values(["ts", "rank", "vehicle_id"]).groupby("ts", sort=True):
            best, low = int(frame.vehicle_id.iloc[0]), float(frame["rank"].iloc[0])
            if last is not None and ts - since <= max_gap + 1e-9:
                same = frame[frame.vehicle_id == last]
                if len(same) and float(same["rank"].iloc[0]) <= low + switch_margin:
                    best = last
            last, since = best, float(ts)
            out.append((key[0], key[1], float(ts), best))
        if ended:
            state.remove()
        else:
            state.update((last, since, held.ts.astype(float).tolist(), held.vehicle_id.astype(int).tolist(), held["rank"].astype(float).tolist()))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["clip_id", "person_id", "ts", "vehicle_id"])

    kept = "last long, since double, ts array<double>, vehicles array<bigint>, ranks array<double>"
    return near.groupBy("clip_id", "person_id").applyInPandasWithState(step, ASSIGNED, kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


STITCHED = "clip_id string, frame_index long, raw_id long, id long"
CORNERS = ["x1", "y1", "x2", "y2"]


def identities(boxes: DataFrame, frames: int = 15, least_iou: float = 0.45, reach: float = 0.2, idle_ms: int = 60_000, wait: int = 0, remember: int = 3000) -> DataFrame:
    """Logical ids for raw ones: a new raw id takes over an id seen up to `frames` frames ago whose box it overlaps or is close to.

    boxes: clip_id, frame_index, raw_id, x1, y1, x2, y2, and perhaps scene: a cut forgets all ids. An id that is seen in a
    frame can't be taken over there. A raw id keeps its logical one until it isn't seen for `remember` frames.
    """
    scenes = "scene" in boxes.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["frame_index", "raw_id", *CORNERS, *(["scene"] if scenes else [])]
        done, scene, seen_json, alias_json, held_json = state.get if state.exists else (None, None, "[]", "[]", "[]")
        seen = pd.DataFrame(json.loads(seen_json), columns=["id", "at", *CORNERS])
        alias = {int(r): (int(i), int(at)) for r, i, at in json.loads(alias_json)}
        held = pd.DataFrame(json.loads(held_json), columns=columns)
        ended = state.hasTimedOut
        rows, held = _ready(held if ended else _gathered(batches, held), "frame_index", 0 if ended else wait, done)
        out = []
        for at, frame in rows.sort_values(["frame_index", "raw_id"]).groupby("frame_index", sort=True):
            if scenes and scene is not None and int(frame.scene.iloc[0]) != scene:
                seen, alias = seen.iloc[:0], {}
            scene = int(frame.scene.iloc[0]) if scenes else None
            seen = seen[at - seen["at"] <= frames]
            raw = [int(r) for r in frame.raw_id]
            known = {r: alias[r][0] for r in raw if r in alias}
            free = seen[~seen.id.isin(known.values())]
            names = {r: name for r, name in zip(raw, _taken(frame, raw, known, free, least_iou, reach), strict=True)}
            alias = {r: x for r, x in alias.items() if at - x[1] <= remember} | {r: (i, int(at)) for r, i in names.items()}
            now = pd.DataFrame({"id": [names[r] for r in raw], "at": int(at)} | {c: frame[c].astype(float).to_numpy() for c in CORNERS})
            seen = pd.concat([x for x in (seen[~seen.id.isin(now.id)], now) if len(x)]).drop_duplicates("id", keep="last")
            out += [(key[0], int(at), r, names[r]) for r in raw]
            done = int(at)
        if ended:
            state.remove()
        else:
            state.update((done, scene, seen[["id", "at", *CORNERS]].to_json(orient="values"), json.dumps([[r, *x] for r, x in alias.items()]), held[columns].to_json(orient="values")))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["clip_id", "frame_index", "raw_id", "id"])

    return boxes.groupBy("clip_id").applyInPandasWithState(step, STITCHED, "done long, scene long, seen string, alias string, held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _taken(frame: pd.DataFrame, raw: list[int], known: dict[int, int], free: pd.DataFrame, least_iou: float, reach: float) -> list[int]:
    """The logical id of each raw id of a frame: the known one, or the best of the free ones that it may take over, each once, or its own."""
    a, b = frame[CORNERS].to_numpy(float), free[CORNERS].to_numpy(float)
    shared = np.clip(np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2]), 0, None).prod(axis=2)
    sides_a, sides_b = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2]
    iou = shared / np.maximum(sides_a.prod(axis=1)[:, None] + sides_b.prod(axis=1) - shared, 1e-6)
    apart = np.linalg.norm((a[:, None, :2] + a[:, None, 2:] - b[None, :, :2] - b[None, :, 2:]) / 2, axis=2)
    apart = apart / np.maximum(np.maximum(sides_a.max(axis=1, initial=1.0)[:, None], sides_b.max(axis=1, initial=1.0)[None, :]), 1.0)
    cost = np.where((iou >= least_iou) | (apart <= reach), apart - 2 * iou, np.inf)
    out = []
    for n, r in enumerate(raw):
        best = int(np.argmin(cost[n])) if cost.shape[1] else -1
        if r in known:
            out.append(known[r])
        elif best >= 0 and np.isfinite(cost[n, best]):
            out.append(int(free.id.iloc[best]))
            cost[:, best] = np.inf
        else:
            out.append(r)
    return out


class Progress(StreamingQueryListener):
    """Counts what a query has read, and what its watermarks have dropped; report() is called after every trigger."""

    def __init__(self, report: Callable[[str, int, int], None] | None = None):
        self.rows: dict[str, int] = {}
        self.late: dict[str, int] = {}
        self.report = report

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        name, p = str(event.progress.id), event.progress
        self.rows[name] = self.rows.get(name, 0) + p.numInputRows
        self.late[name] = self.late.get(name, 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        if self.report:
            self.report(name, self.rows[name], self.late[name])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def propagated(boxes: DataFrame, most: int = 12, decay: float = 0.85) -> DataFrame:
    """Boxes carried over short gaps at constant velocity, with a confidence that decays; `observed` tells them from seen ones.

    boxes: clip_id, id, frame_index, x1, y1, x2, y2, conf. In batch: each gap is filled from its last
    two sightings.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("clip_id", "id").orderBy("frame_index")
    corners = ("x1", "y1", "x2", "y2")
    seen = boxes.withColumns({"_next": F.lead("frame_index").over(order), "_step": F.col("frame_index") - F.lag("frame_index").over(order), **{f"_d{c}": F.col(c) - F.lag(c).over(order) for c in corners}})
    away = F.coalesce(F.col("_next") - F.col("frame_index") - 1, F.lit(most))
    filled = seen.withColumn("_k", F.explode(F.sequence(F.lit(0), F.when(F.col("_next").isNull(), 0).otherwise(F.least(away, F.lit(most))).cast("int"))))
    speed = lambda c: F.coalesce(F.col(f"_d{c}") / F.col("_step"), F.lit(0.0))
    return filled.select("clip_id", "id", (F.col("frame_index") + F.col("_k")).alias("frame_index"), *[F.round(F.col(c) + speed(c) * F.col("_k"), 2).alias(c) for c in corners], F.round(F.greatest(F.lit(0.01), F.col("conf") * F.pow(F.lit(decay), F.col("_k"))), 4).alias("conf"), (F.col("_k") == 0).alias("observed"))
