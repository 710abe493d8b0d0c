"""Queries on detections, review samples and the training of a candidate filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stie.functions import geometry as G
from stie.functions import text as X
from stie.operators import detections as D
from stie.operators import folds, learning
from stie.operators import suppress as S
from stie.operators import tracks as T
from stie.plans.on_tracks import gap_sql, inter_sql, side_sql
from stie.sources.views import DURATION, FRAMES, SPANS, TRACKS, frames_objects, read, spans
from stie.sources.views import tracks as track_view

QUERIES, ORACLES = {}, {}
WIDTH, HEIGHT = 640, 480
CORNERS = ("x1", "y1", "x2", "y2")


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def detected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Heads, people and vehicles of crowded frames; the less sure boxes are the heads."""
    boxes = frames_objects(spark, sf_dir)
    head, person = F.col("conf") <= 0.93, F.col("kind") == "person"
    columns = ["frame", "obj", *CORNERS]
    return boxes.where(head).select(*columns), boxes.where(~head & person).select(*columns), boxes.where(~head & ~person).select(*columns)


def holds_sql(box: str, margin: float, head: str = "h") -> str:
    x, y, m = f"({head}.x1 + {head}.x2) / 2", f"({head}.y1 + {head}.y2) / 2", f"{margin}::DOUBLE"
    return f"{x} BETWEEN {box}.x1 - ({box}.x2 - {box}.x1) * {m} AND {box}.x2 + ({box}.x2 - {box}.x1) * {m} AND {y} BETWEEN {box}.y1 - ({box}.y2 - {box}.y1) * {m} AND {box}.y2 + ({box}.y2 - {box}.y1) * {m}"


HEADS_SQL = f"""{FRAMES}, h AS (SELECT * FROM fo WHERE conf <= 0.93), p AS (SELECT * FROM fo WHERE conf > 0.93 AND kind = 'person'), v AS (SELECT * FROM fo WHERE conf > 0.93 AND kind <> 'person'),
free AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.frame = h.frame AND {holds_sql('p', 0.12)})
  AND NOT EXISTS (SELECT 1 FROM v WHERE v.frame = h.frame AND {holds_sql('v', 0.2)} AND greatest(h.x2 - h.x1, 1) > 0.7::DOUBLE * greatest(v.x2 - v.x1, 1)))"""
BODY_SQL = f"""greatest((x1 + x2) / 2 - greatest(x2 - x1, 1) * 3.2::DOUBLE / 2, 0) AS x1, greatest(y1 - greatest(y2 - y1, 1) * 0.2::DOUBLE, 0) AS y1,
least((x1 + x2) / 2 + greatest(x2 - x1, 1) * 3.2::DOUBLE / 2, {WIDTH}) AS x2, least(y1 + greatest(y2 - y1, 1) * 6.5::DOUBLE, {HEIGHT}) AS y2"""


@query(f"WITH {HEADS_SQL} SELECT frame, obj FROM free")
def free_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads that stand for people whom no box shows."""
    return D.new_heads(*detected(spark, sf_dir), ["frame"], widest=0.7).select("frame", "obj")


@query(f"WITH {HEADS_SQL}, b AS (SELECT frame, obj, {BODY_SQL} FROM free) SELECT frame, obj, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM b")
def head_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bodies that are inferred from these heads."""
    body = G.body_from_head(G.Box.of(), WIDTH, HEIGHT)
    free = D.new_heads(*detected(spark, sf_dir), ["frame"], widest=0.7)
    return free.select("frame", "obj", *[F.round(getattr(body, c), 6).alias(c) for c in CORNERS])


@query(f"""WITH {HEADS_SQL}, b AS (SELECT frame, obj, {BODY_SQL} FROM free),
i AS (SELECT p.frame, p.obj, b.obj AS head, {inter_sql('p', 'b')} / greatest((p.x2 - p.x1) * (p.y2 - p.y1) + greatest(b.x2 - b.x1, 0) * greatest(b.y2 - b.y1, 0) - {inter_sql('p', 'b')}, 1e-6) AS iou FROM p JOIN b USING (frame)),
o AS (SELECT frame, obj, arg_min(head, (-round(iou, 9), head)) AS head FROM i WHERE iou >= 0.2 GROUP BY ALL),
n AS (SELECT p.frame, p.obj, arg_min(h.obj, ((h.y1 + h.y2) / 2, -(h.x2 - h.x1), h.obj)) AS head FROM p JOIN h ON p.frame = h.frame AND {holds_sql('p', 0.05)} GROUP BY ALL)
SELECT p.frame, p.obj, coalesce(o.head, n.head) AS head_obj FROM p LEFT JOIN o ON o.frame = p.frame AND o.obj = p.obj LEFT JOIN n ON n.frame = p.frame AND n.obj = p.obj""")
def head_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of every person: of an inferred body that the box overlaps, or inside it."""
    heads, people, vehicles = detected(spark, sf_dir)
    free = D.new_heads(heads, people, vehicles, ["frame"], widest=0.7)
    return D.attributed(people, heads, free, ["frame"], least=0.2, width=WIDTH, height=HEIGHT).select("frame", "obj", "head_obj")


@query(f"""WITH {HEADS_SQL}, k AS (SELECT p.*, conf >= 0.97 AS has_head, x2 - (x2 - x1) * 0.25::DOUBLE AS hx FROM p)
SELECT p.frame, p.obj AS person, v.obj AS vehicle, p.has_head FROM k p JOIN v USING (frame) WHERE CASE WHEN p.has_head THEN {gap_sql()} / greatest(p.x2 - p.hx, 1e-6) <= 4 ELSE {gap_sql()} <= {side_sql()} * 0.5::DOUBLE END""")
def near_by_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that are near in head widths where a head is known, else by the vehicle's side."""
    boxes = frames_objects(spark, sf_dir).where("conf > 0.93")
    person, vehicle = G.Box.of("p_"), G.Box.of("v_")
    has = F.col("p_conf") >= 0.97
    head = G.Box(F.when(has, person.x2 - person.width * 0.25), person.y1, person.x2, person.y2)
    near = T.pairs(boxes, ["frame"], "obj").where(G.near_with_head(person, vehicle, head, 0.5, 4.0))
    return near.select("frame", F.col("p_obj").alias("person"), F.col("v_obj").alias("vehicle"), has.alias("has_head"))


@query(f"""WITH {FRAMES} SELECT frame, obj FROM fo p WHERE kind = 'person' AND EXISTS (SELECT 1 FROM fo v WHERE v.frame = p.frame AND v.kind <> 'person' AND p.x1 <= v.x2 + {side_sql()} * 0.15::DOUBLE AND p.x2 >= v.x1 - {side_sql()} * 0.15::DOUBLE
AND p.y1 <= v.y2 + {side_sql()} * 0.15::DOUBLE AND p.y2 >= v.y1 - {side_sql()} * 0.15::DOUBLE)""")
def near_any_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People who touch a widened vehicle."""
    pairs = T.pairs(frames_objects(spark, sf_dir), ["frame"], "obj").where(G.near_expanded(G.Box.of("p_"), G.Box.of("v_")))
    return pairs.select("frame", F.col("p_obj").alias("obj")).distinct()


@query(f"""WITH {FRAMES} SELECT p.frame, p.obj AS person, arg_min(v.obj, ({gap_sql()}, v.obj)) AS vehicle FROM fo p JOIN fo v ON p.frame = v.frame AND p.kind = 'person' AND v.kind <> 'person' GROUP BY ALL""")
def nearest_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vehicle with the least gap to every person; of equal ones the first by name."""
    pairs = T.pairs(frames_objects(spark, sf_dir), ["frame"], "obj")
    best = F.min_by("v_obj", F.struct(G.gap(G.Box.of("p_"), G.Box.of("v_")), F.col("v_obj")))
    return pairs.groupBy("frame", F.col("p_obj").alias("person")).agg(best.alias("vehicle"))


BOTH = "(greatest(least(a.x2, bs[i + 1].x2) - greatest(a.x1, bs[i + 1].x1), 0) * greatest(least(a.y2, bs[i + 1].y2) - greatest(a.y1, bs[i + 1].y1), 0))"
CROP_SQL = f"""{FRAMES}, r0 AS (SELECT frame, obj, conf AS motion, greatest(trunc(x1 - 0.6::DOUBLE * {side_sql('fo')}), 0) AS x1, greatest(trunc(y1 - 0.6::DOUBLE * {side_sql('fo')}), 0) AS y1,
  least(trunc(x2 + 0.6::DOUBLE * {side_sql('fo')}), {WIDTH}) AS x2, least(trunc(y2 + 0.6::DOUBLE * {side_sql('fo')}), {HEIGHT}) AS y2 FROM fo WHERE kind <> 'person' AND conf >= 0.92),
o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY motion DESC, x1 DESC, y1 DESC, x2 DESC, y2 DESC, obj) AS k FROM r0 WHERE x2 - x1 >= 48 AND y2 - y1 >= 48),
b AS (SELECT frame, list({{'obj': obj, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY k) AS bs FROM o GROUP BY frame),
r AS (SELECT frame, bs, 1 AS i, bs[:1] AS kept FROM b UNION ALL SELECT frame, bs, i + 1, CASE WHEN len(kept) < 4 AND len(list_filter(kept, lambda a: {BOTH} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (bs[i + 1].x2 - bs[i + 1].x1) * (bs[i + 1].y2 - bs[i + 1].y1) - {BOTH}) > 0.65)) = 0
  THEN list_append(kept, bs[i + 1]) ELSE kept END FROM r WHERE i < len(bs)), e AS (SELECT frame, unnest(kept) AS u FROM r WHERE i = len(bs))"""


@query("WITH RECURSIVE " + CROP_SQL + " SELECT frame, u.obj AS obj, u.x1::INT AS x1, u.y1::INT AS y1, u.x2::INT AS x2, u.y2::INT AS y2 FROM e")
def motion_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most four regions around vehicles of a frame, those that move most and don't overlap much."""
    region = G.motion_region(G.Box.of(), WIDTH, HEIGHT)
    vehicles = frames_objects(spark, sf_dir).where("kind <> 'person' AND conf >= 0.92")
    crops = vehicles.select("frame", "obj", F.col("conf").alias("motion"), *[getattr(region, c).alias(c) for c in CORNERS]).where("x2 - x1 >= 48 AND y2 - y1 >= 48")
    return S.motion_crops(crops, ["frame"]).select("frame", "obj", "x1", "y1", "x2", "y2")


@query(f"""WITH RECURSIVE {TRACKS}, n AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY ts) AS k FROM (SELECT DISTINCT clip_id, ts FROM tracks)),
g AS (SELECT clip_id, k, ts, ts + 0.25::DOUBLE AS due, true AS keep FROM n WHERE k = 1
  UNION ALL SELECT n.clip_id, n.k, n.ts, CASE WHEN n.ts + 1e-6 >= g.due THEN n.ts + 0.25::DOUBLE ELSE g.due END, n.ts + 1e-6 >= g.due FROM g JOIN n ON n.clip_id = g.clip_id AND n.k = g.k + 1) SELECT clip_id, ts FROM g WHERE keep""")
def frame_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames at least a quarter of a second apart."""
    frames = track_view(spark, sf_dir).select("clip_id", "ts").distinct()
    return folds.fold(frames, ["clip_id"], ["ts"], lambda rows: D.time_gate(rows, 4.0), "clip_id int, ts double")


@query(f"""WITH {TRACKS}, f AS (SELECT clip_id, list(ts ORDER BY ts) AS fs FROM (SELECT DISTINCT clip_id, ts FROM tracks) GROUP BY clip_id), i AS (SELECT clip_id, fs, unnest(generate_series(0, 7)) AS k FROM f),
s AS (SELECT clip_id, round(min(ts) + 0.03, 3) AS a, round(max(ts) - 0.03, 3) AS b FROM tracks WHERE kind = 'person' GROUP BY clip_id, id), t AS (SELECT DISTINCT clip_id, unnest([a, (a + b) / 2, b]) AS t FROM s),
e AS (SELECT t.clip_id, len(list_filter(fs, lambda x: x < t.t)) AS n, fs FROM t JOIN f USING (clip_id))
SELECT clip_id, fs[(floor(k * (len(fs) - 1) / 7))::BIGINT + 1] AS ts FROM i UNION SELECT clip_id, fs[n] FROM e WHERE n > 0 UNION SELECT clip_id, fs[n + 1] FROM e WHERE n < len(fs)""")
def review_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight even frames of every clip, and those beside the bounds and middles of its people's spans."""
    t = track_view(spark, sf_dir)
    seen = t.where("kind = 'person'").groupBy("clip_id", "id").agg(F.round(F.min("ts") + 0.03, 3).alias("start_s"), F.round(F.max("ts") - 0.03, 3).alias("end_s"))
    return D.review_frames(t.select("clip_id", "ts").distinct(), seen, ["clip_id"], 8)


@query(f"""WITH {TRACKS}, x AS (SELECT clip_id, frame_index, ts, list_sort(list(id)) AS ids FROM tracks WHERE kind = 'person' GROUP BY ALL), y AS (SELECT clip_id, frame_index, ts + 0.002::DOUBLE * (frame_index % 5) AS ts, list_sort(list(id)) AS ids FROM tracks WHERE kind = 'person' AND conf >= 0.91 GROUP BY ALL)
SELECT coalesce(x.clip_id, y.clip_id) AS clip_id, count(*) AS frames, round(avg(CASE WHEN x.ids = y.ids THEN 1.0 ELSE 0.0 END), 6) AS agreement, round(max(abs(x.ts - y.ts)), 6) AS max_time_error
FROM x FULL JOIN y ON x.clip_id = y.clip_id AND x.frame_index = y.frame_index GROUP BY ALL""")
def render_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far what is drawn agrees with what was to be drawn."""
    t = track_view(spark, sf_dir).where("kind = 'person'")
    active = lambda rows: rows.groupBy("clip_id", "frame_index", "ts").agg(F.collect_list("id").alias("active"))
    drawn = active(t.where("conf >= 0.91")).withColumn("ts", F.col("ts") + F.lit(0.002) * (F.col("frame_index") % 5))
    return D.render_quality(active(t), drawn, ["clip_id"])


@query(f"""WITH {TRACKS} SELECT clip_id, frame_index, id, printf('%s%02d_%03d', CASE WHEN kind = 'person' THEN 'p' ELSE 'v' END, scene, id) AS name, round(greatest(0.01, conf * 0.85::DOUBLE), 6) AS carried, least(1280, greatest(640, (x2 - x1)::BIGINT * 8, (y2 - y1)::BIGINT * 8)) AS image_size,
trunc(ts / {DURATION}::DOUBLE * 639)::INT AS pixel FROM tracks""")
def track_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of every box, the confidence that it would carry over a gap, its place on the timeline."""
    box = G.Box.of()
    name = F.when(F.col("kind") == "person", X.track_id("p", F.col("scene"), F.col("id"))).otherwise(X.track_id("v", F.col("scene"), F.col("id")))
    size = G.image_size(F.round(box.width).cast("long") * 8, F.round(box.height).cast("long") * 8, 1280)
    return track_view(spark, sf_dir).select("clip_id", "frame_index", "id", name.alias("name"), F.round(G.decayed(F.col("conf"), 0.85), 6).alias("carried"), size.alias("image_size"), G.timeline_pixel(F.col("ts"), F.lit(DURATION), F.lit(640)).alias("pixel"))


@query(f"""WITH {TRACKS}, w AS (SELECT *, count(*) OVER (PARTITION BY clip_id, id) AS n, row_number() OVER (PARTITION BY clip_id, id ORDER BY ts) AS a, row_number() OVER (PARTITION BY clip_id, id ORDER BY ts DESC) AS z FROM tracks)
SELECT clip_id, id, max(n) AS n, round(avg(x1) FILTER (a <= least(3, n // 2)), 6) AS first_mean, round(avg(x1) FILTER (z <= least(3, n // 2)), 6) AS last_mean FROM w GROUP BY ALL""")
def edge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every track begins and ends, over up to three boxes."""
    return T.edge_means(track_view(spark, sf_dir), ["clip_id", "id"], "ts", "x1")


@query(f"""WITH {TRACKS}, g AS (SELECT 0.2::DOUBLE + unnest(generate_series(0, 24)) * 0.025::DOUBLE AS threshold), s AS (SELECT x1 / 600 AS p, kind = 'person' AS y FROM tracks),
c AS (SELECT threshold, count(*) FILTER (p >= threshold AND y) AS tp, count(*) FILTER (p >= threshold AND NOT y) AS fp, count(*) FILTER (p < threshold AND y) AS fn FROM s CROSS JOIN g GROUP BY ALL)
SELECT round(threshold, 6) AS threshold, round(2 * tp / greatest(1, 2 * tp + fp + fn), 6) AS f1 FROM c ORDER BY 2 * tp / greatest(1, 2 * tp + fp + fn) DESC, threshold DESC LIMIT 1""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut of a score with the best F1."""
    scored = track_view(spark, sf_dir).select((F.col("x1") / 600).alias("probability"), (F.col("kind") == "person").cast("int").alias("label"))
    return learning.best_threshold(scored).select(F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"))


@query("""WITH l AS (SELECT event_type, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY ALL), k AS (SELECT event_type, ids, unnest(generate_series(0, 49)) AS k FROM l)
SELECT DISTINCT event_type, ids[(floor(k * (len(ids) - 1) / 49))::BIGINT + 1] AS event_id FROM k""")
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty events of each type, evenly spread."""
    return learning.spread_sample(read(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", ["event_id"], 50)


UNSURE_SQL = f"""{SPANS}, c AS (SELECT * FROM spans WHERE side = 0), u AS (SELECT * FROM spans WHERE side = 1 AND type = 'other_interaction'), r AS (SELECT * FROM spans WHERE side = 1 AND type <> 'other_interaction')"""


@query(f"""WITH {UNSURE_SQL} SELECT c.clip_id, c.event_id AS candidate_id, (EXISTS (SELECT 1 FROM r WHERE r.clip_id = c.clip_id AND greatest(least(c.end_s, r.end_s) - greatest(c.start_s, r.start_s), 0) >= 0.5::DOUBLE * (r.end_s - r.start_s)))::INT AS label
FROM c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.clip_id = c.clip_id AND least(c.end_s, u.end_s) - greatest(c.start_s, u.start_s) > 0)""")
def labelled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows: candidates that touch nothing uncertain, 1 if they cover half of a reference."""
    s, keys = spans(spark, sf_dir), ["clip_id"]
    unsure = F.col("type") == "other_interaction"
    sure = learning.without_uncertain(s.where("side = 0").select("clip_id", F.col("event_id").alias("candidate_id"), "start_s", "end_s"), s.where((F.col("side") == 1) & unsure), keys)
    return learning.labelled(sure, s.where((F.col("side") == 1) & ~unsure), keys).select("clip_id", "candidate_id", "label")
