"""Reading and writing clips, tracks, events and reports as JSON documents.

Schemas are given, never inferred. Paths are Spark paths; nothing is opened on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "array<double>"
OBJECT = f"struct<id:string,kind:string,bbox:{BOX},confidence:double,observed:boolean,source:string,head_bbox:{BOX},tracking_bbox:{BOX},raw_id:string>"
TRACK_ROW = f"frame_index bigint, timestamp_s double, scene int, objects array<{OBJECT}>"
SPAN = "struct<start_s:double,end_s:double>"
EVENT = f"struct<event_id:string,type:string,persons:array<struct<person_id:string,description:string>>,vehicle:struct<vehicle_id:string,description:string>,spans:array<{SPAN}>,truncated_start:boolean,truncated_end:boolean,evidence_frames:array<bigint>,group_id:string>"
CLIP = f"schema_version string, clip_id string, source_sha256 string, status string, duration_s double, frame_count bigint, interactions array<{EVENT}>, error string"
REFERENCE = f"struct<duration_s:double,interactions:array<{EVENT}>>"
UNCERTAIN = "struct<duration_s:double,uncertain_spans:array<struct<start_s:double,end_s:double,note:string>>>"
RAW_BOXES = f"frame bigint, t double, boxes array<{BOX}>"


def stem() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)


def clip_files(spark: SparkSession, path: str, pattern: str = "*.mp4") -> DataFrame:
    """clip_id, path, length, sha256 of all files; two with one name, or none at all, is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    found = files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("clip_id"), "path", "length", F.sha2("content", 256).alias("sha256"))
    twice = found.groupBy("clip_id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"names that occur more than once: {', '.join(sorted(r.clip_id for r in twice))}")
    if found.isEmpty():
        raise FileNotFoundError(f"no {pattern} under {path}")
    return found


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """One row an object, from JSON lines with one frame a line; the clip is the file's name."""
    rows = spark.read.schema(TRACK_ROW).json(path).withColumn("clip_id", stem())
    flat = rows.select("clip_id", "frame_index", F.col("timestamp_s").alias("ts"), "scene", F.explode("objects").alias("o"))
    return flat.select("clip_id", "frame_index", "ts", "scene", "o.id", "o.kind", *[F.col("o.bbox")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], F.col("o.confidence").alias("conf"), F.coalesce("o.observed", F.lit(True)).alias("observed"), F.col("o.head_bbox").alias("head"))


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    """Clip documents, one a file."""
    return spark.read.schema(CLIP).option("multiLine", "true").json(path)


def read_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """clip_id, value from documents that map clip ids to values."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("clip_id", "value"))


def read_raw_boxes(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(RAW_BOXES).json(path).withColumn("clip_id", stem())
    return rows.select("clip_id", "frame", "t", F.posexplode("boxes").alias("box", "b")).select("clip_id", "frame", "t", "box", *[F.col("b")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2", "score"))])


def unknown_keys(spark: SparkSession, path: str, allowed: list[str]) -> DataFrame:
    """clip_id, unknown of documents with keys that the schema doesn't have; reading alone would drop them."""
    keys = F.json_object_keys(F.col("value"))
    return spark.read.text(path, wholetext=True).select(stem().alias("clip_id"), F.array_except(keys, F.lit(allowed)).alias("unknown")).where(F.size("unknown") > 0)


def event_spans(events: DataFrame, column: str = "interactions") -> DataFrame:
    """One row a span; events are told apart by their place, as reference ids may repeat."""
    flat = events.select("clip_id", F.posexplode(column).alias("event_no", "e"))
    return flat.select("clip_id", "event_no", "e.event_id", "e.type", F.col("e.persons")[0]["person_id"].alias("person_id"), F.col("e.vehicle.vehicle_id").alias("vehicle_id"), F.explode("e.spans").alias("s")).select("*", "s.start_s", "s.end_s").drop("s")


def flat_interactions(clips: DataFrame) -> DataFrame:
    return clips.select("clip_id", F.explode("interactions").alias("e")).select("clip_id", "e.*")


def probe(frames: DataFrame) -> DataFrame:
    """clip_id, frame_count, duration_s: the last time plus the last frame's duration, else the median step, else 1/25 s. frames: clip_id, frame_index, ts, duration."""
    from pyspark.sql import Window as W

    stepped = frames.withColumn("step", F.col("ts") - F.lag("ts").over(W.partitionBy("clip_id").orderBy("frame_index")))
    last = F.max_by("duration", "frame_index")
    return stepped.groupBy("clip_id").agg(F.count("*").alias("frame_count"), (F.max("ts") + F.coalesce(last, F.median("step"), F.lit(0.04))).alias("duration_s"), F.coalesce(F.min("step"), F.lit(1.0)).alias("least_step"))


def write_documents(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON, one folder a key if `by` is given; a reader sees all of a write or nothing of it in the commit's terms."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def missing(inventory: DataFrame, artifacts: DataFrame, key: str = "clip_id") -> DataFrame:
    return inventory.select(key).join(artifacts.select(key), key, "left_anti")


def deliverable(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of every file: the index that goes with a delivery."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def stale(index: DataFrame, now: DataFrame) -> DataFrame:
    """Entries of either side that the other doesn't have alike."""
    names = ["path", "length", "sha256"]
    gone = index.select(names).exceptAll(now.select(names)).withColumn("side", F.lit("index"))
    return gone.unionByName(now.select(names).exceptAll(index.select(names)).withColumn("side", F.lit("files")))


def next_number(folders: DataFrame, column: str = "name") -> int:
    """One more than the greatest number among names that are numbers."""
    found = folders.select(F.regexp_extract(column, r"^(?:experiment_)?(\d+)$", 1).alias("n")).where("n <> ''").agg(F.max(F.col("n").cast("int"))).first()[0]
    return (found or 0) + 1
