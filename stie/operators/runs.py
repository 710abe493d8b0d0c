"""Runs and experiments: inventories, manifests, selections of clips and metric rows, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stie.config import Config
from stie.operators import events as E
from stie.operators.expansion import expanded
from stie.operators.intervals import overlapping_pairs


def experiment_rank(name: Column) -> Column:
    """Sorts names like experiment_12 and experiment_12_variant: by number, the base before its variants; other names come last."""
    rest = F.regexp_replace(name, "^experiment_", "")
    number = F.regexp_extract(rest, r"^(\d+)(_.*)?$", 1)
    variant = F.regexp_extract(rest, r"^\d+_(.*)$", 1)
    plain = number == ""
    return F.struct(F.when(plain, 10**9).otherwise(F.expr("0") + number.try_cast("long")).alias("number"), F.when(plain | F.contains(rest, F.lit("_")), 1).otherwise(0).alias("is_variant"), F.when(plain, name).otherwise(variant).alias("variant"))


def subset(rows: DataFrame, splits: DataFrame, name: str | None, key: str = "clip_id") -> DataFrame:
    """The rows of the clips of one split; all of them for None or `all`. splits: split, clip_id."""
    return rows if name in (None, "all") else rows.join(splits.where(F.col("split") == name).select(key).distinct(), key, "left_semi")


def selected_metric(metrics: DataFrame, keys: list[str], wanted: list[tuple[float, bool]]) -> DataFrame:
    """For each key, the first of the wanted (threshold, typed) rows that there is; keys without any are missing. metrics: keys, threshold, typed, and values."""
    turn = F.coalesce(*[F.when((F.round("threshold", 6) == round(t, 6)) & (F.col("typed") == F.lit(y)), i) for i, (t, y) in enumerate(wanted)])
    rows = metrics.withColumn("_turn", turn).where(F.col("_turn").isNotNull())
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy("_turn"))).where("_nth = 1").drop("_turn", "_nth")


def scene_table(metrics: DataFrame, key: str = "clip_id") -> DataFrame:
    """The rows with `place`, worst F1 first and clips in order among equals; without an F1 before all."""
    return metrics.withColumn("place", F.row_number().over(W.orderBy(F.col("f1").asc_nulls_first(), key)))


def accepted_events(events: DataFrame, candidates: DataFrame, keys: tuple[str, ...] = ("clip_id", "person_id", "vehicle_id")) -> DataFrame:
    """Events that an accepted candidate of the same pair overlaps. candidates: keys, start_s, end_s; events need event_id within the clip."""
    hit = overlapping_pairs(events.select(*keys, "event_id", "start_s", "end_s"), candidates.select(*keys, "start_s", "end_s"), list(keys)).select("clip_id", "event_id").distinct()
    return events.join(hit, ["clip_id", "event_id"], "left_semi")


def inventory_status(inventory: DataFrame, clips: DataFrame, checks: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every clip of the inventory with what there is of it.

    inventory: clip_id, duration_s; clips: clip_id, status, events; checks: clip_id, decoded; reviews: clip_id, decision, one row a
    candidate. A clip without a document is `missing`; counts of candidates are null where nothing was reviewed.
    """
    counts = reviews.groupBy("clip_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("decision") == "uncertain").alias("uncertain"))
    found = inventory.join(clips.withColumn("_there", F.lit(True)), "clip_id", "left").join(checks.select("clip_id", "decoded"), "clip_id", "left").join(counts, "clip_id", "left")
    return found.select(
        "clip_id", "duration_s", F.coalesce("_there", F.lit(False)).alias("schema_valid"), F.coalesce("status", F.lit("missing")).alias("status"), "events",
        F.coalesce("decoded", F.lit(False)).alias("video_valid"), "candidates", "uncertain",
    )


def completeness(status: DataFrame) -> DataFrame:
    """One row: how many clips there are, are ok, are valid, have a valid video; seconds; uncertain candidates."""
    return status.agg(
        F.count("*").alias("input_clips"), F.count_if(F.col("status") == "ok").alias("successful"), F.count_if("schema_valid").alias("schema_valid"), F.count_if("video_valid").alias("video_valid"),
        F.round(F.sum("duration_s"), 3).alias("seconds"), F.sum("candidates").alias("candidates"), F.sum("uncertain").alias("uncertain"),
    )


def record(spark: SparkSession, path: str, config: Config, clips: DataFrame) -> None:
    """Appends clips (clip_id, status, events, error) to the manifest of runs, under the hash of the configuration."""
    from stie.functions.text import fingerprint

    clips.select(fingerprint({"config": F.lit(config.json())}).alias("config_sha256"), F.lit(config.json()).alias("config"), F.current_timestamp().alias("at"), "clip_id", "status", "events", "error").write.mode("append").parquet(path)


def failures(clips: DataFrame) -> DataFrame:
    """The clips that failed, for an error sink of their own: those can be run again alone."""
    return clips.where("status = 'error'")


def uncached(found: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add to the cache, one row of counts): of each signature that the cache lacks, one; rows without a signature are skipped. Both: signature, path."""
    fresh = found.where(F.col("signature").isNotNull()).groupBy("signature").agg(F.min("path").alias("path")).join(cache.select("signature").distinct(), "signature", "left_anti")
    return fresh, found.agg(F.count("*").alias("n")).crossJoin(fresh.agg(F.count("*").alias("copied"))).select("copied", (F.col("n") - F.col("copied")).alias("skipped"))


def derived_expansion(events: DataFrame, boxes: DataFrame, duration: Column, config: Config) -> DataFrame:
    """A saved run's events under other expansion limits: expanded, merged and made exclusive again."""
    wide = expanded(E.merged(events), boxes, duration, config.expand_near, config.expand_gap_s, config.expand_extension_s)
    return E.merged(E.exclusive_spans(E.merged(wide), boxes))


def config_values(spark: SparkSession, configs: dict[str, Config]) -> DataFrame:
    """name, key, value: every parameter of every configuration, as JSON."""
    from dataclasses import asdict

    rows = [(name, k, str(v)) for name, c in sorted(configs.items()) for k, v in sorted(asdict(c).items())]
    return spark.createDataFrame(rows, "name string, key string, value string")


def config_differences(values: DataFrame, old: str, new: str) -> DataFrame:
    """key, before, after: parameters that differ between two configurations, or that one of them lacks."""
    side = lambda name, column: values.where(F.col("name") == name).select("key", F.col("value").alias(column))
    return side(old, "before").join(side(new, "after"), "key", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
