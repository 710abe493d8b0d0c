"""One document a clip with a sentence for every final event and the reviews that it rests on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stie.functions import text as X
from stie.operators.intervals import overlapping_pairs

# What the documents say of themselves.
VERSION, SOURCE = "2.0", "final_event_with_vlm_evidence"


def documents(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """clip_id, schema_version, descriptions, in the order of the events' ids.

    events: clip_id, event_id, type, people (array of person_id, description), vehicle_id, vehicle_description, start_s, end_s.
    reviews: clip_id, candidate_id, decision, person_id, vehicle_id, start_s, end_s, reason. An event rests on the interactions of
    one of its people and its vehicle that overlap it; it needs none. Clips without events have no document.
    """
    pair = ["clip_id", "person_id", "vehicle_id"]
    who = events.select("clip_id", "event_id", "vehicle_id", "start_s", "end_s", F.explode("people").alias("p")).select("clip_id", "event_id", "vehicle_id", "start_s", "end_s", "p.person_id")
    told = reviews.where("decision = 'interaction'").select(*pair, "candidate_id", "start_s", "end_s", "reason")
    met = overlapping_pairs(who, told, pair).select("clip_id", "event_id", F.struct(F.col("r_candidate_id").alias("id"), F.col("r_reason").alias("reason")).alias("r"))
    rests = met.groupBy("clip_id", "event_id").agg(F.array_sort(F.collect_set("r")).alias("rests"))
    found = events.join(rests, ["clip_id", "event_id"], "left").withColumn("rests", F.coalesce("rests", F.array().cast("array<struct<id:string,reason:string>>")))
    ids = F.array_sort(F.array_distinct(F.transform("people", lambda p: p["person_id"])))
    said = F.filter(F.transform("rests", lambda r: F.trim(r["reason"])), lambda x: F.coalesce(F.length(x), F.lit(0)) > 0)
    sentence = X.sentence(F.transform("people", lambda p: X.person_phrase(p["description"], p["person_id"])), F.col("type"), X.vehicle_phrase(F.col("vehicle_description"), F.col("vehicle_id")))
    numbered = found.withColumn("n", F.row_number().over(W.partitionBy("clip_id").orderBy("event_id")))
    entry = F.struct(
        X.ordinal_id("d", F.col("n"), 4).alias("description_id"), "event_id", F.transform("rests", lambda r: r["id"]).alias("candidate_ids"), ids.alias("person_ids"), F.get(ids, F.lit(0)).alias("person_id"), "vehicle_id",
        "start_s", "end_s", F.lit("interaction").alias("decision"), F.col("type").alias("final_type"), sentence.alias("description"), said.alias("raw_vlm_descriptions"), F.lit(SOURCE).alias("source"),
    )
    return numbered.select("clip_id", entry.alias("d")).groupBy("clip_id").agg(F.array_sort(F.collect_list("d")).alias("descriptions")).select("clip_id", F.lit(VERSION).alias("schema_version"), "descriptions")
