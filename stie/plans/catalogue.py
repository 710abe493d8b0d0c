"""The registered queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stie.plans import on_detections, on_events, on_runs, on_sightings, on_spans, on_tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**on_spans.QUERIES, **on_tracks.QUERIES, **on_events.QUERIES, **on_detections.QUERIES, **on_sightings.QUERIES, **on_runs.QUERIES}
ORACLES: dict[str, str] = {**on_spans.ORACLES, **on_tracks.ORACLES, **on_events.ORACLES, **on_detections.ORACLES, **on_sightings.ORACLES, **on_runs.ORACLES}
