"""Queries on the `tracks` and `frames_objects` views: geometry, pairing, candidates, summaries, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stie.config import HELD, RELEASED
from stie.functions import geometry as G
from stie.operators import candidates, events, graph
from stie.operators import intervals as I
from stie.operators import suppress as S
from stie.operators import tracks as T
from stie.operators.nearest import Rule, best_pairs, nested_components
from stie.sources.views import DURATION, FRAMES, TRACKS, frames_objects, tracks
from stie.streaming import tracking

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def gap_sql(p: str = "p", v: str = "v") -> str:
    return f"sqrt(pow(greatest({p}.x1 - {v}.x2, {v}.x1 - {p}.x2, 0), 2) + pow(greatest({p}.y1 - {v}.y2, {v}.y1 - {p}.y2, 0), 2))"


def side_sql(v: str = "v") -> str:
    return f"greatest({v}.x2 - {v}.x1, {v}.y2 - {v}.y1)"


def inter_sql(p: str = "p", v: str = "v") -> str:
    return f"(greatest(least({p}.x2, {v}.x2) - greatest({p}.x1, {v}.x1), 0) * greatest(least({p}.y2, {v}.y2) - greatest({p}.y1, {v}.y1), 0))"


def area_sql(b: str) -> str:
    return f"(({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1))"


def center_sql(p: str = "p", v: str = "v") -> str:
    return f"(sqrt(pow(({p}.x1 + {p}.x2) / 2 - ({v}.x1 + {v}.x2) / 2, 2) + pow(({p}.y1 + {p}.y2) / 2 - ({v}.y1 + {v}.y2) / 2, 2)) / {side_sql(v)})"


@query(f"""WITH {FRAMES} SELECT p.frame, p.obj AS person, v.obj AS vehicle, round({inter_sql()} / ({area_sql('p')} + {area_sql('v')} - {inter_sql()}), 6) AS iou, round({inter_sql()} / least({area_sql('p')}, {area_sql('v')}), 6) AS contained,
round({gap_sql()}, 6) AS gap, round({gap_sql()} / {side_sql()}, 6) AS norm_gap, round({center_sql()}, 6) AS center, round(((p.x1 + p.x2) / 2 - v.x1) / (v.x2 - v.x1), 6) AS along,
(p.x1 + p.x2) / 2 BETWEEN v.x1 AND v.x2 AND (p.y1 + p.y2) / 2 BETWEEN v.y1 AND v.y2 AS inside, round((p.y2 - p.y1) / (p.x2 - p.x1), 6) AS aspect
FROM fo p JOIN fo v ON p.frame = v.frame AND p.kind = 'person' AND v.kind <> 'person'""")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, v = G.Box.of("p_"), G.Box.of("v_")
    r = lambda x, n: F.round(x, 6).alias(n)
    return T.pairs(frames_objects(spark, sf_dir), ["frame"]).select(
        "frame", F.col("p_obj").alias("person"), F.col("v_obj").alias("vehicle"), r(G.iou(p, v), "iou"), r(G.containment(p, v), "contained"), r(G.gap(p, v), "gap"), r(G.normalized_gap(p, v), "norm_gap"),
        r(G.center_distance(p, v), "center"), r(G.longitudinal(p, v), "along"), G.contains(v, *p.center).alias("inside"), r(p.aspect, "aspect"),
    )


@query(f"WITH {FRAMES} SELECT p.frame, p.obj AS person, v.obj AS vehicle FROM fo p JOIN fo v ON p.frame = v.frame AND p.kind = 'person' AND v.kind <> 'person' WHERE {gap_sql()} <= 2.0 * {side_sql()}")
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.near_pairs(frames_objects(spark, sf_dir), ["frame"], 2.0, crowded=False).select("frame", F.col("p_obj").alias("person"), F.col("v_obj").alias("vehicle"))


@query(f"""WITH {FRAMES} SELECT frame, person, vehicle FROM (SELECT p.frame, p.obj AS person, v.obj AS vehicle, row_number() OVER (PARTITION BY p.frame, p.obj ORDER BY {gap_sql()} / {side_sql()}, v.obj) AS nth
FROM fo p JOIN fo v ON p.frame = v.frame AND p.kind = 'person' AND v.kind <> 'person' WHERE {gap_sql()} <= 2.0 * {side_sql()}) WHERE nth = 1""")
def exclusive_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = T.near_pairs(frames_objects(spark, sf_dir), ["frame"], 2.0, crowded=False)
    return T.nearest(near, ["frame", "p_obj"], [G.normalized_gap(G.Box.of("p_"), G.Box.of("v_")), F.col("v_obj")]).select("frame", F.col("p_obj").alias("person"), F.col("v_obj").alias("vehicle"))


def ranked_sql(body: bool = False, center: float = 0.2, confidence: float = 0.02, people: str = "") -> str:
    base = f"({gap_sql()} / {side_sql()} + {center}::DOUBLE * {center_sql()} - {confidence}::DOUBLE * v.conf)"
    rank = base
    if body:
        y = "(p.y1 + 0.6::DOUBLE * (p.y2 - p.y1))"
        m = "0.08::DOUBLE * greatest(v.y2 - v.y1, 1)"
        x = "(p.x1 + p.x2) / 2"
        upright = "count(*) OVER (PARTITION BY p.clip_id, p.frame_index, p.id) >= 2 AND (p.y2 - p.y1) / (p.x2 - p.x1) >= 1.5 AND p.conf >= 0.2"
        rank = f"CASE WHEN {upright} THEN CASE WHEN {y} BETWEEN v.y1 - {m} AND v.y2 + {m} THEN 0.0 ELSE 2.0 END + greatest(v.x1 - {x}, {x} - v.x2, 0) / greatest(v.x2 - v.x1, 1) + 0.01::DOUBLE * {base} ELSE {base} END"
    return f"""{TRACKS}, n AS (SELECT p.clip_id, p.frame_index, p.ts, p.scene, p.id AS person_id, v.id AS vehicle_id, round({rank}, 9) AS rank
  FROM tracks p JOIN tracks v ON p.clip_id = v.clip_id AND p.frame_index = v.frame_index AND p.kind = 'person' AND v.kind <> 'person' WHERE {gap_sql()} <= 0.2::DOUBLE * {side_sql()}{people})"""


@query(f"WITH {ranked_sql(True)} SELECT clip_id, frame_index, person_id, vehicle_id, rank FROM n")
def vehicle_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ranked(tracks(spark, sf_dir), body=True).select("clip_id", "frame_index", "person_id", "vehicle_id", "rank")


def hold_sql(ranked: str) -> str:
    return f"""WITH RECURSIVE {ranked}, f AS (SELECT clip_id, person_id, frame_index, ts, scene, row_number() OVER (PARTITION BY clip_id, person_id ORDER BY ts) AS k, arg_min(vehicle_id, (rank, vehicle_id)) AS best, min(rank) AS low, map(list(vehicle_id), list(rank)) AS ranks
  FROM n GROUP BY clip_id, person_id, frame_index, ts, scene),
h AS (SELECT clip_id, person_id, frame_index, ts, scene, k, best AS vehicle_id FROM f WHERE k = 1
  UNION ALL SELECT f.clip_id, f.person_id, f.frame_index, f.ts, f.scene, f.k, CASE WHEN f.ts - h.ts <= 1.0 + 1e-9 AND coalesce(f.ranks[h.vehicle_id] <= f.low + 0.05, false) THEN h.vehicle_id ELSE f.best END
  FROM h JOIN f ON f.clip_id = h.clip_id AND f.person_id = h.person_id AND f.k = h.k + 1)"""


HOLD_SQL = hold_sql(ranked_sql())


@query(HOLD_SQL + " SELECT clip_id, person_id, frame_index, vehicle_id FROM h")
def vehicle_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.assigned_best(tracks(spark, sf_dir)).select("clip_id", "person_id", "frame_index", "vehicle_id")


SESSIONS_SQL = """, g AS (SELECT *, sum(fresh) OVER (PARTITION BY clip_id, person_id, vehicle_id, scene ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY clip_id, person_id, vehicle_id, scene ORDER BY ts) > 1.0 + 1e-9 THEN 1 ELSE 0 END AS fresh FROM h)),
e AS (SELECT clip_id, person_id, vehicle_id, scene, min(ts) AS start_s, max(ts) AS end_s, count(*) AS n FROM g GROUP BY clip_id, person_id, vehicle_id, scene, s)"""
CANDIDATES_SQL = HOLD_SQL + SESSIONS_SQL


@query(CANDIDATES_SQL + " SELECT * FROM e")
def candidate_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.candidate_sessions(T.assigned_best(tracks(spark, sf_dir))).drop("session")


WINDOWS_SQL = f""", p AS (SELECT clip_id, person_id, vehicle_id, scene, greatest(0, start_s - 1.5) AS a, least({DURATION}, end_s + 1.5) AS b FROM e),
w AS (SELECT *, unnest(generate_series(0, greatest(1, ceil((b - a - 2) / 6 - 1e-9))::BIGINT - 1)) AS k FROM p),
x AS (SELECT clip_id, person_id, vehicle_id, scene, k, round(a + k * 6, 3) AS start_s, round(least(b, a + k * 6 + 8), 3) AS end_s FROM w)
SELECT clip_id, person_id, vehicle_id, scene, start_s, end_s, format('c{{:04d}}', row_number() OVER (PARTITION BY clip_id ORDER BY person_id, vehicle_id, scene, start_s, end_s, k)) AS candidate_id FROM x"""


@query(CANDIDATES_SQL + WINDOWS_SQL)
def candidate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.propose(tracks(spark, sf_dir), DURATION, HELD)


#: People whom the released configuration believes in: five boxes over 0.75 s, or a short upright track that begins or ends at a vehicle.
VALID_SQL = f"""o AS (SELECT *, row_number() OVER (PARTITION BY clip_id, id ORDER BY ts) AS a, row_number() OVER (PARTITION BY clip_id, id ORDER BY ts DESC) AS z FROM tracks WHERE kind = 'person'),
ok AS (SELECT clip_id, id FROM o GROUP BY clip_id, id HAVING count(*) >= 5 AND max(ts) - min(ts) >= 0.75 - 1e-9
  UNION SELECT clip_id, id FROM o GROUP BY clip_id, id HAVING count(*) >= 2 AND list_sort(list(greatest(0, y2 - y1) / greatest(1, x2 - x1)))[(count(*) // 2 + 1)::BIGINT] >= 0.85
    AND (clip_id, id) IN (SELECT (p.clip_id, p.id) FROM o p JOIN tracks v ON p.clip_id = v.clip_id AND p.frame_index = v.frame_index AND v.kind <> 'person' WHERE (p.a <= 2 OR p.z <= 2) AND {gap_sql()} <= 0.2::DOUBLE * {side_sql()}))"""
RELEASED_RANKS_SQL = ranked_sql(True, 0.0, 0.0, " AND EXISTS (SELECT 1 FROM ok WHERE ok.clip_id = p.clip_id AND ok.id = p.id)").replace(TRACKS, f"{TRACKS}, {VALID_SQL}", 1)


@query(hold_sql(RELEASED_RANKS_SQL) + SESSIONS_SQL + WINDOWS_SQL)
def released_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proposal under the released configuration: valid people, the body rule among several vehicles, hysteresis."""
    return candidates.propose(tracks(spark, sf_dir), DURATION, RELEASED)


@query()
def linked_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of all frames without their ids, linked to tracks anew: by place, velocity and kind alone."""
    seen = tracks(spark, sf_dir).select(F.col("clip_id").cast("string").alias("clip_id"), F.col("frame_index").cast("long").alias("frame_index"), F.timestamp_millis((F.col("ts") * 1000).cast("long")).alias("at"), F.col("scene").cast("long").alias("scene"), "kind", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], F.col("conf").cast("double").alias("conf"))
    return tracking.linked(seen)


@query(f"WITH {TRACKS} SELECT clip_id, id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM tracks WHERE kind = 'person' GROUP BY clip_id, id HAVING count(*) >= 75 AND max(ts) - min(ts) >= 36")
def valid_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.valid_tracks(tracks(spark, sf_dir).where("kind = 'person'"), ["clip_id", "id"], 75, 36.0)


@query(f"""WITH {TRACKS}, p AS (SELECT *, (y2 - y1) / (x2 - x1) AS aspect, row_number() OVER (PARTITION BY clip_id, id ORDER BY ts) AS a, row_number() OVER (PARTITION BY clip_id, id ORDER BY ts DESC) AS z FROM tracks WHERE kind = 'person'),
s AS (SELECT clip_id, id, count(*) AS n, list_sort(list(aspect))[(count(*) // 2 + 1)::BIGINT] AS aspect FROM p GROUP BY ALL)
SELECT clip_id, id, n, round(aspect, 6) AS aspect FROM s WHERE n >= 2 AND aspect >= 0.85 AND EXISTS (SELECT 1 FROM p JOIN tracks v ON p.clip_id = v.clip_id AND p.frame_index = v.frame_index AND v.kind <> 'person'
  WHERE p.clip_id = s.clip_id AND p.id = s.id AND (p.a <= 2 OR p.z <= 2) AND {gap_sql()} <= 0.2::DOUBLE * {side_sql()})""")
def short_track_exception(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.short_exceptions(tracks(spark, sf_dir), ["clip_id", "id"]).withColumn("aspect", F.round("aspect", 6))


@query(f"""WITH {TRACKS}, a AS (SELECT clip_id, id AS vehicle_id, round(sum((x2 - x1) * (y2 - y1)), 6) AS area FROM tracks WHERE kind <> 'person' AND scene = 0 AND ts < 5 GROUP BY ALL)
SELECT clip_id, vehicle_id, area FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY area DESC, vehicle_id) AS nth FROM a) WHERE nth = 1""")
def dominant_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.dominant_vehicle(tracks(spark, sf_dir), 5.0)


VELOCITY_SQL = """v AS (SELECT clip_id, scene, id, count(*) AS n, arg_max(cx, ts) - arg_min(cx, ts) AS dx, arg_max(cy, ts) - arg_min(cy, ts) AS dy, max(ts) - min(ts) AS dt FROM (
  SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, row_number() OVER (PARTITION BY clip_id, scene, id ORDER BY ts DESC) AS nth FROM tracks WHERE kind = 'person') WHERE nth <= 4 GROUP BY ALL),
s AS (SELECT clip_id, scene, id, n, round(CASE WHEN dt > 0 THEN dx / dt ELSE 0 END, 6) AS vx, round(CASE WHEN dt > 0 THEN dy / dt ELSE 0 END, 6) AS vy FROM v)"""


@query(f"WITH {TRACKS}, {VELOCITY_SQL} SELECT * FROM s")
def track_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.velocities(tracks(spark, sf_dir).where("kind = 'person'"), ["clip_id", "scene", "id"])


TRACKLETS_SQL = f"""t AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, id * 100000 + floor(frame_index / 20)::BIGINT AS tid FROM tracks WHERE kind = 'person'),
w AS (SELECT t.clip_id, t.scene, t.tid, t.frame_index, arg_min(v.id, ({gap_sql('t', 'v')}, v.id)) AS vehicle FROM t JOIN tracks v ON t.clip_id = v.clip_id AND t.frame_index = v.frame_index AND v.kind <> 'person' GROUP BY ALL),
l AS (SELECT clip_id, scene, tid AS id, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(cx, ts) AS first_x, arg_min(cy, ts) AS first_y, arg_max(cx, ts) AS last_x, arg_max(cy, ts) AS last_y, arg_max(greatest(x2 - x1, y2 - y1), ts) AS side,
  min(frame_index) AS ff, max(frame_index) AS lf FROM t GROUP BY ALL),
q AS (SELECT clip_id, scene, tid AS id, arg_max(cx, ts) - arg_min(cx, ts) AS dx, arg_max(cy, ts) - arg_min(cy, ts) AS dy, max(ts) - min(ts) AS dt FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, scene, tid ORDER BY ts DESC) AS nth FROM t) WHERE nth <= 4 GROUP BY ALL),
r AS (SELECT l.*, round(CASE WHEN dt > 0 THEN dx / dt ELSE 0 END, 6) AS vx, round(CASE WHEN dt > 0 THEN dy / dt ELSE 0 END, 6) AS vy, a.vehicle AS first_vehicle, b.vehicle AS last_vehicle FROM l JOIN q USING (clip_id, scene, id)
  JOIN w a ON a.clip_id = l.clip_id AND a.scene = l.scene AND a.tid = l.id AND a.frame_index = ff JOIN w b ON b.clip_id = l.clip_id AND b.scene = l.scene AND b.tid = l.id AND b.frame_index = lf),
d AS (SELECT o.clip_id, o.id AS old_id, n.id AS new_id, round(n.first_ts - o.last_ts, 6) AS gap_s, n.first_x - o.last_x AS dx, n.first_y - o.last_y AS dy, o.vx, o.vy, o.side FROM r o JOIN r n ON o.clip_id = n.clip_id AND o.scene = n.scene AND o.last_vehicle = n.first_vehicle AND o.id <> n.id),
c AS (SELECT clip_id, old_id, new_id, gap_s, round(sqrt(pow(dx - vx * gap_s, 2) + pow(dy - vy * gap_s, 2)) / greatest(side, 1), 6) AS distance,
  round(CASE WHEN sqrt(vx * vx + vy * vy) * sqrt(dx * dx + dy * dy) > 0 THEN (vx * dx + vy * dy) / (sqrt(vx * vx + vy * vy) * sqrt(dx * dx + dy * dy)) ELSE 1 END, 6) AS cosine FROM d WHERE gap_s > 0 AND gap_s <= 0.5)"""


def _tracklets(t: DataFrame) -> DataFrame:
    """Tracks cut into pieces of 20 frames, with what stitching needs."""
    pieces = t.where("kind = 'person'").withColumn("piece", F.col("id") * 100000 + F.floor(F.col("frame_index") / 20))
    keys = ["clip_id", "scene", "piece"]
    cx, cy = G.Box.of().center
    ends = pieces.groupBy(*keys).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by(cx, "ts").alias("first_x"), F.min_by(cy, "ts").alias("first_y"), F.max_by(cx, "ts").alias("last_x"), F.max_by(cy, "ts").alias("last_y"),
        F.max_by(G.Box.of().side, "ts").alias("side"), F.min("frame_index").alias("ff"), F.max("frame_index").alias("lf"),
    )
    near = best_pairs(pieces.drop("kind"), t.where("kind <> 'person'").select(*T.FRAME, "id", "x1", "y1", "x2", "y2", "conf"), T.FRAME, Rule(None, 0.0, 0.0, plain=True))
    vehicle = near.groupBy("clip_id", F.col("p_scene").alias("scene"), F.col("p_piece").alias("piece"), "frame_index").agg(F.min_by("v_id", F.struct(G.gap(G.Box.of("p_"), G.Box.of("v_")), F.col("v_id"))).alias("vehicle"))
    at = lambda frame, name: vehicle.withColumnsRenamed({"frame_index": frame, "vehicle": name})
    speed = T.velocities(pieces, keys).drop("n")
    return ends.join(speed, keys).join(at("ff", "first_vehicle"), [*keys, "ff"]).join(at("lf", "last_vehicle"), [*keys, "lf"]).withColumnRenamed("piece", "id")


@query(f"WITH {TRACKS}, {TRACKLETS_SQL} SELECT * FROM c WHERE distance <= 3 AND cosine >= 0")
def tracklet_stitch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.stitch_candidates(_tracklets(tracks(spark, sf_dir)), reach=3.0)


STITCH_SQL = f"""WITH RECURSIVE {TRACKS}, {TRACKLETS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY distance, gap_s, -cosine, old_id, new_id) AS n FROM c WHERE distance <= 3 AND cosine >= 0),
g AS (SELECT clip_id, 0::BIGINT AS n, []::BIGINT[] AS olds, []::BIGINT[] AS news FROM (SELECT DISTINCT clip_id FROM o)
  UNION ALL SELECT g.clip_id, o.n, CASE WHEN list_contains(olds, old_id) OR list_contains(news, new_id) THEN olds ELSE list_append(olds, old_id) END, CASE WHEN list_contains(olds, old_id) OR list_contains(news, new_id) THEN news ELSE list_append(news, new_id) END FROM g JOIN o ON o.clip_id = g.clip_id AND o.n = g.n + 1),
lk AS (SELECT clip_id, unnest(arg_max(olds, n)) AS a, unnest(arg_max(news, n)) AS b FROM g GROUP BY clip_id),
sy AS (SELECT clip_id, a, b FROM lk UNION SELECT clip_id, b, a FROM lk), cl AS (SELECT clip_id, a AS node, a AS r FROM sy UNION SELECT cl.clip_id, sy.b, cl.r FROM cl JOIN sy ON sy.clip_id = cl.clip_id AND sy.a = cl.node)
SELECT clip_id, node, min(r) AS root FROM cl GROUP BY ALL"""


@query(STITCH_SQL)
def tracklet_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id with the first id of the chain of tracklets that it belongs to."""
    links = T.greedy_one_to_one(T.stitch_candidates(_tracklets(tracks(spark, sf_dir)), reach=3.0), ["clip_id"])
    return graph.components(links.select("clip_id", F.col("old_id").alias("a"), F.col("new_id").alias("b")), ["clip_id"])


def _instants(t: DataFrame) -> DataFrame:
    """clip_id, t: start, middle and end of every track."""
    spans = t.groupBy("clip_id", "id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.select("clip_id", F.explode(F.array("a", F.round((F.col("a") + F.col("b")) / 2, 3), "b")).alias("t")).distinct()


@query(f"""WITH {TRACKS}, f AS (SELECT DISTINCT clip_id, frame_index, ts FROM tracks), i AS (SELECT DISTINCT clip_id, t FROM (SELECT clip_id, unnest([min(ts), round((min(ts) + max(ts)) / 2, 3), max(ts)]) AS t FROM tracks GROUP BY clip_id, id))
SELECT clip_id, round(t, 3) AS t, frame_index, ts FROM (SELECT i.clip_id, t, f.frame_index, f.ts, row_number() OVER (PARTITION BY i.clip_id, t ORDER BY round(abs(f.ts - t), 9), f.ts) AS nth FROM i JOIN f USING (clip_id)) WHERE nth = 1""")
def nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    frames = t.select("clip_id", "frame_index", "ts").distinct()
    instants = _instants(t)
    return T.as_of(instants, frames, ["clip_id"], "t", "ts").withColumn("t", F.round("t", 3))


@query(f"""WITH {TRACKS}, f AS (SELECT DISTINCT clip_id, frame_index, ts FROM tracks), i AS (SELECT DISTINCT clip_id, t FROM (SELECT clip_id, unnest([min(ts), round((min(ts) + max(ts)) / 2, 3), max(ts)]) AS t FROM tracks GROUP BY clip_id, id))
SELECT clip_id, round(t, 3) AS t, frame_index, ts FROM (SELECT i.clip_id, t, f.frame_index, f.ts, row_number() OVER (PARTITION BY i.clip_id, t ORDER BY round(abs(f.ts - t), 9), f.ts) AS nth FROM i JOIN f USING (clip_id)) WHERE nth = 1""")
def nearest_frame_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, of which a task looks through five seconds of a clip."""
    t = tracks(spark, sf_dir)
    frames = t.select("clip_id", "frame_index", "ts").distinct()
    return T.as_of(_instants(t), frames, ["clip_id"], "t", "ts", bucket=5.0).withColumn("t", F.round("t", 3))


@query(f"""WITH {TRACKS}, f AS (SELECT DISTINCT clip_id, ts FROM tracks), i AS (SELECT DISTINCT clip_id, t FROM (SELECT clip_id, unnest([min(ts), round((min(ts) + max(ts)) / 2, 3), max(ts)]) AS t FROM tracks GROUP BY clip_id, id))
SELECT clip_id, round(t, 3) AS t, max(CASE WHEN ts <= t THEN ts END) AS before, min(CASE WHEN ts >= t THEN ts END) AS after FROM i JOIN f USING (clip_id) GROUP BY ALL""")
def asof_forward_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    frames = t.select("clip_id", "ts").distinct()
    instants = _instants(t)
    back = T.as_of(instants, frames, ["clip_id"], "t", "ts", "backward").withColumnRenamed("ts", "before")
    return T.as_of(back, frames, ["clip_id"], "t", "ts", "forward").select("clip_id", F.round("t", 3).alias("t"), "before", F.col("ts").alias("after"))


SUPPRESS_SQL = FRAMES + """, o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY {order}) AS k FROM fo), b AS (SELECT frame, list({{'obj': obj, 'kind': kind, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY k) AS bs FROM o GROUP BY frame),
r AS (SELECT frame, bs, 1 AS i, bs[:1] AS kept FROM b
  UNION ALL SELECT frame, bs, i + 1, CASE WHEN len(list_filter(kept, lambda a: {clash})) = 0 THEN list_append(kept, bs[i + 1]) ELSE kept END FROM r WHERE i < len(bs)),
e AS (SELECT frame, unnest(kept) AS u FROM r WHERE i = len(bs))"""
BOTH = "(greatest(least(a.x2, bs[i + 1].x2) - greatest(a.x1, bs[i + 1].x1), 0) * greatest(least(a.y2, bs[i + 1].y2) - greatest(a.y1, bs[i + 1].y1), 0))"
AREA_A, AREA_B = "((a.x2 - a.x1) * (a.y2 - a.y1))", "((bs[i + 1].x2 - bs[i + 1].x1) * (bs[i + 1].y2 - bs[i + 1].y1))"


@query("WITH RECURSIVE " + SUPPRESS_SQL.format(order="conf DESC, obj", clash=f"a.kind = bs[i + 1].kind AND {BOTH} / ({AREA_A} + {AREA_B} - {BOTH}) >= 0.1") + " SELECT frame, u.obj AS obj FROM e")
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.suppress(frames_objects(spark, sf_dir), ["frame"], 0.1).select("frame", "obj")


@query("WITH RECURSIVE " + SUPPRESS_SQL.format(order="(x2 - x1) * (y2 - y1) DESC, obj", clash=f"(a.kind = 'person') = (bs[i + 1].kind = 'person') AND {BOTH} > 0.3 * {AREA_B}") + " SELECT frame, u.obj AS obj FROM e")
def containment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drop_contained(frames_objects(spark, sf_dir), ["frame"], 0.3).select("frame", "obj")


@query(f"""WITH {TRACKS}, f AS (SELECT clip_id, frame_index, sum(x2 + y2) / count(*) AS level FROM tracks GROUP BY ALL), d AS (SELECT *, round(abs(level - lag(level) OVER (PARTITION BY clip_id ORDER BY frame_index)), 6) AS diff FROM f)
SELECT clip_id, frame_index, sum(CASE WHEN diff > 55 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING)::BIGINT AS scene_no FROM d""")
def scene_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = tracks(spark, sf_dir).groupBy("clip_id", "frame_index").agg((F.sum(F.col("x2") + F.col("y2")) / F.count("*")).alias("level"))
    changed = frames.withColumn("diff", F.round(F.abs(F.col("level") - F.lag("level").over(W.partitionBy("clip_id").orderBy("frame_index"))), 6))
    return T.scene_numbers(changed, ["clip_id"], "diff").select("clip_id", "frame_index", "scene_no")


@query(f"""WITH {TRACKS}, f AS (SELECT clip_id, frame_index, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM tracks WHERE kind = 'person' GROUP BY ALL)
SELECT clip_id, frame_index, ids FROM (SELECT *, lag(ids) OVER (PARTITION BY clip_id ORDER BY frame_index) AS before FROM f) WHERE before IS NOT NULL AND before <> ids""")
def visibility_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.visibility_changes(tracks(spark, sf_dir).where("kind = 'person'"), ["clip_id"])


@query(f"""WITH {TRACKS}, m AS (SELECT *, row_number() OVER (PARTITION BY clip_id, id ORDER BY ts) - sum((conf >= 0.95)::INT) OVER (PARTITION BY clip_id, id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM tracks)
SELECT clip_id, id, max(n)::BIGINT AS longest FROM (SELECT clip_id, id, run, sum((conf >= 0.95)::INT) AS n FROM m GROUP BY ALL) GROUP BY ALL""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.longest_runs(tracks(spark, sf_dir), ["clip_id", "id"], "ts", F.col("conf") >= 0.95)


@query(f"""WITH {TRACKS}, s AS (SELECT clip_id, id, list(frame_index ORDER BY frame_index) AS fs FROM tracks WHERE kind = 'person' GROUP BY ALL),
i AS (SELECT clip_id, id, fs, unnest(generate_series(0, 7)) AS k FROM s) SELECT DISTINCT clip_id, id, fs[floor(k * (len(fs) - 1) / 7)::BIGINT + 1]::INT AS frame_index FROM i""")
def linspace_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight evenly spread frames of every track."""
    frames = tracks(spark, sf_dir).where("kind = 'person'").groupBy("clip_id", "id").agg(F.sort_array(F.collect_list("frame_index")).alias("fs"))
    at = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.floor(k * (F.size("fs") - 1) / 7).cast("int"))
    return frames.select("clip_id", "id", F.explode(F.array_distinct(F.transform(at, lambda p: F.element_at("fs", p + 1)))).alias("frame_index"))


ALIAS_EDGES = f"""ed AS (SELECT a.clip_id, a.id AS a, b.id AS b FROM tracks a JOIN tracks b ON a.clip_id = b.clip_id AND a.frame_index = b.frame_index AND a.kind <> 'person' AND b.kind <> 'person' AND a.id < b.id
  AND {inter_sql('a', 'b')} / least({area_sql('a')}, {area_sql('b')}) >= 0.8 GROUP BY ALL HAVING count(*) >= 3)"""


@query(f"""WITH RECURSIVE {TRACKS}, {ALIAS_EDGES}, s AS (SELECT clip_id, a, b FROM ed UNION SELECT clip_id, b, a FROM ed), c AS (SELECT clip_id, a AS node, a AS r FROM s UNION SELECT c.clip_id, s.b, c.r FROM c JOIN s ON s.clip_id = c.clip_id AND s.a = c.node)
SELECT clip_id, node, min(r) AS root FROM c GROUP BY ALL""")
def vehicle_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles that lie in each other in three frames or more are one; the least id stands for them."""
    return nested_components(tracks(spark, sf_dir).where("kind <> 'person'"), "clip_id", "frame_index", 0.8, 3)


EVENTS_SQL = CANDIDATES_SQL + ", ev AS (SELECT clip_id, person_id, vehicle_id, scene, start_s, round(end_s + 0.1, 1) AS end_s, CASE (person_id + vehicle_id) % 3 WHEN 0 THEN 'enter' WHEN 1 THEN 'exit' ELSE 'other_interaction' END AS type FROM e)"


def episodes(t: DataFrame) -> DataFrame:
    """An event for every session of a person at a vehicle."""
    return session_events(T.candidate_sessions(T.assigned_best(t)))


def session_events(found: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(F.lit("enter"), F.lit("exit"), F.lit("other_interaction")), ((F.col("person_id") + F.col("vehicle_id")) % 3 + 1).cast("int"))
    return found.select("clip_id", "person_id", "vehicle_id", "scene", "start_s", F.round(F.col("end_s") + 0.1, 1).alias("end_s"), kind.alias("type"))


EDGE_SQL = EVENTS_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY start_s, end_s, person_id, vehicle_id) AS n FROM ev),
ee AS (SELECT a.clip_id, a.n AS a, b.n AS b FROM o a JOIN o b ON a.clip_id = b.clip_id AND a.vehicle_id = b.vehicle_id AND a.n < b.n AND least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s) > 0
  AND (round((least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)) / (greatest(a.end_s, b.end_s) - least(a.start_s, b.start_s)), 6) >= 0.5 OR round((least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)) / least(a.end_s - a.start_s, b.end_s - b.start_s), 6) >= 0.8)),
s2 AS (SELECT clip_id, a, b FROM ee UNION SELECT clip_id, b, a FROM ee), c2 AS (SELECT clip_id, a AS node, a AS r FROM s2 UNION SELECT c2.clip_id, s2.b, c2.r FROM c2 JOIN s2 ON s2.clip_id = c2.clip_id AND s2.a = c2.node),
l2 AS (SELECT o.*, coalesce(r, n) AS root FROM o LEFT JOIN (SELECT clip_id, node, min(r) AS r FROM c2 GROUP BY ALL) x ON x.clip_id = o.clip_id AND x.node = o.n)"""


def _episode_roots(t: DataFrame) -> DataFrame:
    numbered = graph.reliable(episodes(t).withColumn("n", F.row_number().over(W.partitionBy("clip_id").orderBy("start_s", "end_s", "person_id", "vehicle_id")).cast("long")))
    pairs = I.overlapping_pairs(numbered, numbered, ["clip_id", "vehicle_id"]).where("n < r_n")
    both = G.overlap(F.col("start_s"), F.col("end_s"), F.col("r_start_s"), F.col("r_end_s"))
    bounds = F.greatest("end_s", "r_end_s") - F.least("start_s", "r_start_s")
    shorter = F.least(F.col("end_s") - F.col("start_s"), F.col("r_end_s") - F.col("r_start_s"))
    linked = pairs.where((F.round(both / bounds, 6) >= 0.5) | (F.round(both / shorter, 6) >= 0.8))
    roots = graph.components(linked.select("clip_id", F.col("n").alias("a"), F.col("r_n").alias("b")), ["clip_id"])
    return numbered.join(roots.withColumnRenamed("node", "n"), ["clip_id", "n"], "left").withColumn("root", F.coalesce("root", "n"))


@query(EDGE_SQL + " SELECT clip_id, n, root FROM l2")
def episode_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are one physical episode, by the first of them."""
    return _episode_roots(tracks(spark, sf_dir)).select("clip_id", "n", "root")


@query(EDGE_SQL + """ SELECT clip_id, root, count(*) AS events, count(DISTINCT person_id) AS people, min(start_s) AS start_s, max(end_s) AS end_s, CASE WHEN count(DISTINCT type) = 1 THEN min(type) ELSE 'other_interaction' END AS type,
CASE WHEN count(DISTINCT type) = 1 THEN arg_max(person_id, (round(end_s - start_s, 6), -n)) ELSE coalesce(arg_max(person_id, (round(end_s - start_s, 6), -n)) FILTER (type = 'other_interaction'), arg_max(person_id, (round(end_s - start_s, 6), -n))) END AS person_id FROM l2 GROUP BY clip_id, root""")
def episode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event an episode: its only type or other_interaction, the person of its longest event of that type (of all, where none has it), its outer bounds."""
    rank = F.struct(F.round(F.col("end_s") - F.col("start_s"), 6), -F.col("n"))
    one_type = F.countDistinct("type") == 1
    kind = F.when(one_type, F.min("type")).otherwise("other_interaction")
    person = F.when(one_type, F.max_by("person_id", rank)).otherwise(F.coalesce(F.max_by("person_id", F.when(F.col("type") == "other_interaction", rank)), F.max_by("person_id", rank)))
    return _episode_roots(tracks(spark, sf_dir)).groupBy("clip_id", "root").agg(
        F.count("*").alias("events"), F.countDistinct("person_id").alias("people"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), kind.alias("type"), person.alias("person_id")
    )


COLLAPSED_SQL = EDGE_SQL + """, vs AS (SELECT clip_id, root, vehicle_id FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, root ORDER BY seconds DESC, vehicle_id) AS nth FROM (SELECT clip_id, root, vehicle_id, round(sum(end_s - start_s), 6) AS seconds FROM l2 GROUP BY ALL)) WHERE nth = 1),
ep AS (SELECT clip_id, root, count(*) AS m, min(start_s) AS start_s, max(end_s) AS end_s, CASE WHEN count(DISTINCT type) = 1 THEN min(type) ELSE 'other_interaction' END AS type,
  CASE WHEN count(DISTINCT type) = 1 THEN arg_max(person_id, (round(end_s - start_s, 6), -n)) ELSE coalesce(arg_max(person_id, (round(end_s - start_s, 6), -n)) FILTER (type = 'other_interaction'), arg_max(person_id, (round(end_s - start_s, 6), -n))) END AS person_id FROM l2 GROUP BY clip_id, root),
ev2 AS (SELECT ep.*, vehicle_id FROM ep JOIN vs USING (clip_id, root)),
mg AS (SELECT *, sum(opens) OVER (PARTITION BY clip_id, type, person_id, vehicle_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN start_s < max(end_s) OVER (PARTITION BY clip_id, type, person_id, vehicle_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM ev2))
SELECT clip_id, type, person_id, vehicle_id, min(start_s) AS start_s, max(end_s) AS end_s, sum(m)::BIGINT AS n_events FROM mg GROUP BY clip_id, type, person_id, vehicle_id, island"""


@query(COLLAPSED_SQL)
def collapsed_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events after duplicates of one episode are taken together, told apart by vehicle ids alone."""
    return events.collapsed(episodes(tracks(spark, sf_dir))).select("clip_id", "type", "person_id", "vehicle_id", "start_s", "end_s", "n_events")


@query(EVENTS_SQL + """, f3 AS (SELECT clip_id, id AS person_id, min(ts) AS seen FROM tracks WHERE kind = 'person' AND conf >= 0.95 GROUP BY ALL)
SELECT ev.clip_id, person_id, vehicle_id, greatest(start_s, seen) AS start_s, end_s, type FROM ev JOIN f3 USING (clip_id, person_id) WHERE greatest(start_s, seen) < end_s""")
def visibility_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events begin no earlier than the first sure sighting of their person."""
    t = tracks(spark, sf_dir)
    seen = t.where("kind = 'person' AND conf >= 0.95").groupBy("clip_id", F.col("id").alias("person_id")).agg(F.min("ts").alias("seen"))
    return I.cut_to(episodes(t), seen, ["clip_id", "person_id"], first="seen").select("clip_id", "person_id", "vehicle_id", "start_s", "end_s", "type")


@query(EVENTS_SQL + """, f3 AS (SELECT clip_id, id AS vehicle_id, min(ts) AS a, max(ts) AS b FROM tracks WHERE kind <> 'person' AND conf >= 0.95 GROUP BY ALL)
SELECT ev.clip_id, person_id, vehicle_id, greatest(start_s, a) AS start_s, least(end_s, b) AS end_s, type FROM ev JOIN f3 USING (clip_id, vehicle_id) WHERE greatest(start_s, a) < least(end_s, b)""")
def vehicle_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    seen = t.where("kind <> 'person' AND conf >= 0.95").groupBy("clip_id", F.col("id").alias("vehicle_id")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return I.cut_to(episodes(t), seen, ["clip_id", "vehicle_id"], first="a", last="b").select("clip_id", "person_id", "vehicle_id", "start_s", "end_s", "type")
