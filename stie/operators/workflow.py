"""The whole method over any number of clips: candidates, the verifier's run, final events and what is said of them, one configuration for all."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stie.config import Config
from stie.operators import candidates, descriptions, emergence, events, graph, verification, verify


def run(boxes: DataFrame, duration: float, config: Config, model: Callable[[pd.DataFrame], pd.Series] | None = None, earlier: DataFrame | None = None, voting: bool = False, detections: DataFrame | None = None, features: DataFrame | None = None, kept: str | None = None) -> dict[str, DataFrame]:
    """`candidates`, `reviews`, `events`, `descriptions`; `splits` if features, and `cues` if detections are given.

    With features (clip_id, id, frame_index, area, f, near; see events.appearance_splits), tracks that turn into somebody else are cut first. With
    detections, people who come out of a vehicle are recovered, and their exits are added last. boxes: clip_id,
    frame_index, ts, scene, id, kind, box, conf. earlier: the answers of runs before, by signature; kept: a folder
    where answers stay, and are taken from, so that a run that was killed goes on. model: by default, the one that the configuration names.
    """
    if model is None and config.verifier not in verify.MODELS:
        raise ValueError(f"no verifier is known as {config.verifier}; pass a model")
    model, out = model or verify.MODELS[config.verifier], {}
    if features is not None:
        out["splits"] = graph.reliable(events.appearance_splits(features, ["clip_id", "id"]))
        boxes = events.split_tracks(boxes, out["splits"], ["clip_id"]).select(*boxes.columns)
    if detections is not None:
        out["cues"] = graph.reliable(emergence.emergence(boxes, detections))
        boxes = emergence.with_chains(boxes, out["cues"])
    out["candidates"] = graph.reliable(candidates.propose(boxes, duration, config))
    found, out["reviews"] = verification.run(out["candidates"], boxes, F.lit(duration), config, model, earlier, voting=voting, kept=kept)
    final = events.assembled(found, boxes, F.lit(duration), config)
    if detections is not None:
        final = emergence.with_exits(final.select("clip_id", "type", "person_id", "vehicle_id", "start_s", "end_s", *events.carried(final)), out["cues"])
    out["events"] = final
    named = final if "event_id" in final.columns else events.merged(final)
    people = F.array(F.struct(F.col("person_id").cast("string").alias("person_id"), F.col("person_description").alias("description")))
    told = named.select("clip_id", "event_id", "type", people.alias("people"), "vehicle_id", "vehicle_description", "start_s", "end_s")
    asked = out["candidates"].select("clip_id", "candidate_id", F.col("person_id").cast("string").alias("person_id"), "vehicle_id", "start_s", "end_s")
    out["descriptions"] = descriptions.documents(told, out["reviews"].join(asked, ["clip_id", "candidate_id"]))
    return out
