"""Queries on assembled events, verifier answers, reports and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stie.functions import geometry as G
from stie.functions import text as X
from stie.operators import events as E
from stie.operators import learning, tracks, verify
from stie.plans.on_tracks import EVENTS_SQL, episodes, gap_sql, side_sql
from stie.sources.views import DURATION, FRAMES, SPANS, TRACKS, frames_objects, read, spans
from stie.sources.views import tracks as track_view

QUERIES, ORACLES = {}, {}



def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def _numbered(t: DataFrame) -> DataFrame:
    return E.merged(episodes(t))


MERGED_SQL = EVENTS_SQL + """, mi AS (SELECT *, sum(opens) OVER (PARTITION BY clip_id, type, person_id, vehicle_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN start_s < max(end_s) OVER (PARTITION BY clip_id, type, person_id, vehicle_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM ev)),
me AS (SELECT *, format('e{:03d}', row_number() OVER (PARTITION BY clip_id ORDER BY start_s, end_s, type, person_id, vehicle_id)) AS event_id FROM (
  SELECT clip_id, type, person_id, vehicle_id, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_events FROM mi GROUP BY clip_id, type, person_id, vehicle_id, island))"""


@query(MERGED_SQL + " SELECT * FROM me")
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(track_view(spark, sf_dir))


EXPAND_SQL = MERGED_SQL + f""", fx AS (SELECT clip_id, ts, row_number() OVER w AS i, lead(ts) OVER w AS nxt FROM (SELECT DISTINCT clip_id, ts FROM tracks) WINDOW w AS (PARTITION BY clip_id ORDER BY ts)),
cx AS (SELECT DISTINCT p.clip_id, p.id AS person_id, v.id AS vehicle_id, p.ts FROM tracks p JOIN tracks v ON p.clip_id = v.clip_id AND p.frame_index = v.frame_index AND p.kind = 'person' AND v.kind <> 'person' WHERE round({gap_sql()} / {side_sql()}, 9) <= 0.25),
nx AS (SELECT me.clip_id, event_id, arg_min(i, (round(abs(ts - start_s), 9), ts)) AS f0, arg_min(i, (round(abs(ts - end_s), 9), ts)) AS g0 FROM me JOIN fx USING (clip_id) GROUP BY ALL),
rx AS (SELECT me.clip_id, event_id, start_s, end_s, f0, g0, fx.i, fx.ts, fx.nxt, cx.ts IS NOT NULL AS close FROM me JOIN nx USING (clip_id, event_id) JOIN fx USING (clip_id) LEFT JOIN cx ON cx.clip_id = me.clip_id AND cx.person_id = me.person_id AND cx.vehicle_id = me.vehicle_id AND cx.ts = fx.ts),
bx AS (SELECT *, coalesce(lead(ts) OVER w, start_s) - ts > 2.0 + 1e-9 OR (NOT close AND coalesce(min(CASE WHEN close THEN ts END) OVER (PARTITION BY clip_id, event_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), start_s) - ts > 0.5 + 1e-9) AS bad FROM rx WHERE i < f0 WINDOW w AS (PARTITION BY clip_id, event_id ORDER BY i)),
b2 AS (SELECT clip_id, event_id, min(ts) FILTER (i > last_bad) AS start_s FROM (SELECT *, coalesce(max(CASE WHEN bad THEN i END) OVER (PARTITION BY clip_id, event_id), 0) AS last_bad FROM bx) GROUP BY ALL),
ax AS (SELECT *, ts - end_s > 2.0 + 1e-9 OR (NOT close AND ts - coalesce(max(CASE WHEN close THEN ts END) OVER (PARTITION BY clip_id, event_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), end_s) > 0.5 + 1e-9) AS bad FROM rx WHERE i > g0),
a2 AS (SELECT clip_id, event_id, least(arg_max(coalesce(nxt, {DURATION}), i) FILTER (i < first_bad), {DURATION}) AS end_s FROM (SELECT *, coalesce(min(CASE WHEN bad THEN i END) OVER (PARTITION BY clip_id, event_id), 1000000000) AS first_bad FROM ax) GROUP BY ALL),
ex AS (SELECT me.* EXCLUDE (start_s, end_s), greatest(0, coalesce(b2.start_s, me.start_s)) AS start_s, least({DURATION}::DOUBLE, greatest(CASE WHEN a2.end_s IS NULL THEN me.end_s ELSE a2.end_s END, coalesce(b2.start_s, me.start_s) + 1e-6)) AS end_s FROM me LEFT JOIN b2 USING (clip_id, event_id) LEFT JOIN a2 USING (clip_id, event_id))"""


@query(EXPAND_SQL + " SELECT clip_id, event_id, start_s, end_s FROM ex")
def boundary_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds moved outwards over close frames."""
    t = track_view(spark, sf_dir)
    return E.expanded(_numbered(t), t, F.lit(DURATION)).select("clip_id", "event_id", "start_s", "end_s")


EVIDENCE_SQL = MERGED_SQL + f""",
vs AS (SELECT clip_id, id AS vehicle_id, min(ts) AS vehicle_first, max(ts) AS vehicle_last FROM tracks WHERE kind <> 'person' GROUP BY ALL),
ps AS (SELECT clip_id, id AS person_id, min(ts) AS person_first, max(ts) AS person_last FROM tracks WHERE kind = 'person' GROUP BY ALL),
ke AS (SELECT * FROM (SELECT me.* EXCLUDE (start_s, end_s), greatest(start_s, vehicle_first) AS start_s, least(end_s, vehicle_last) AS end_s, vehicle_last, person_last FROM me JOIN vs USING (clip_id, vehicle_id) LEFT JOIN ps USING (clip_id, person_id)) WHERE start_s < end_s),
se AS (SELECT ke.clip_id, ke.event_id, ke.vehicle_id, p.ts, p.x1, p.y1, p.x2, p.y2 FROM ke JOIN tracks p ON p.clip_id = ke.clip_id AND p.kind = 'person' AND p.id = ke.person_id AND p.ts >= start_s AND p.ts <= end_s),
pr AS (SELECT event_id, clip_id, ts, gap, along FROM (SELECT p.clip_id, p.event_id, p.ts, round({gap_sql()} / {side_sql()}, 9) AS gap, round(((p.x1 + p.x2) / 2 - v.x1) / (v.x2 - v.x1), 9) AS along,
  row_number() OVER (PARTITION BY p.clip_id, p.event_id, p.ts ORDER BY round(abs(v.ts - p.ts), 9), v.ts) AS nth FROM se p JOIN tracks v ON v.clip_id = p.clip_id AND v.id = p.vehicle_id AND v.kind <> 'person' AND v.ts BETWEEN p.ts - 3 AND p.ts + 3) WHERE nth = 1),
pk AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY ts) AS a, row_number() OVER (w ORDER BY ts DESC) AS z FROM pr WINDOW w AS (PARTITION BY clip_id, event_id)),
pm AS (SELECT clip_id, event_id, max(n) AS n, round(avg(CASE WHEN a <= least(3, n // 2) THEN gap END), 6) AS gap_first, round(avg(CASE WHEN z <= least(3, n // 2) THEN gap END), 6) AS gap_last,
  round(avg(CASE WHEN a <= least(3, n // 2) THEN along END), 6) AS along_first, round(avg(CASE WHEN z <= least(3, n // 2) THEN along END), 6) AS along_last, min(CASE WHEN z <= 3 THEN gap END) AS gap_tail, arg_max(along, ts) AS along_end FROM pk GROUP BY ALL),
r0 AS (SELECT ke.*, pm.* EXCLUDE (clip_id, event_id) FROM ke LEFT JOIN pm USING (clip_id, event_id)),
r1 AS (SELECT *, CASE WHEN type = 'door_operation' AND vehicle_last >= person_last + 0.3 AND person_last BETWEEN end_s - 0.5 AND end_s + 1.5 AND gap_tail <= 0.1 THEN 'enter' ELSE type END AS t1 FROM r0),
r2 AS (SELECT *, CASE WHEN t1 IN ('other_interaction', 'door_operation') AND n >= 3 AND vehicle_last >= person_last + 0.3 AND person_last BETWEEN end_s - 1.5 AND end_s + 1.5 AND round(gap_first - gap_last, 6) >= 0.08 AND gap_last <= 0.1 THEN 'enter' ELSE t1 END AS t2 FROM r1),
r3 AS (SELECT *, CASE WHEN t2 = 'enter' AND coalesce(n >= 4 AND gap_first <= 0.1 AND (round(gap_last - gap_first, 6) >= 0.08 OR (abs(round(along_end - along_first, 6)) >= 0.45 AND along_first BETWEEN 0.18 AND 0.82 AND (along_end <= 0.18 OR along_end >= 0.82))), false) THEN 'exit' ELSE t2 END AS final_type FROM r2)"""


@query(EVIDENCE_SQL + " SELECT clip_id, event_id, type, final_type, n FROM r3")
def consistency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track_view(spark, sf_dir)
    return E.consistent(E.evidence_of(_numbered(t), t)).select("clip_id", "event_id", "type", "final_type", "n")


@query()
def assembled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain from verified events to final ones."""
    t = track_view(spark, sf_dir)
    return E.assembled(episodes(t), t, F.lit(DURATION))


OBSERVED_SQL = MERGED_SQL + f""", ob AS (SELECT me.clip_id, me.event_id, me.type, p.ts, (p.x1 + p.x2) / 2 BETWEEN v.x1 AND v.x2 AND (p.y1 + p.y2) / 2 BETWEEN v.y1 AND v.y2 AS inside, round({gap_sql()} / {side_sql()}, 9) AS gap
  FROM me JOIN tracks p ON p.clip_id = me.clip_id AND p.id = me.person_id AND p.kind = 'person' AND p.ts >= start_s - 1 AND p.ts < end_s + 1 JOIN tracks v ON v.clip_id = p.clip_id AND v.frame_index = p.frame_index AND v.id = me.vehicle_id AND v.kind <> 'person')"""


def _observed(t: DataFrame) -> DataFrame:
    p, v = G.Box.of("p_"), G.Box.of("v_")
    events = _numbered(t)
    both = tracks.together(events, t, (F.col("p_ts") >= F.col("start_s") - 1) & (F.col("p_ts") < F.col("end_s") + 1))
    return both.select(*events.columns, F.col("p_ts").alias("ts"), G.contains(v, *p.center).alias("inside"), F.round(G.normalized_gap(p, v), 9).alias("gap"))


@query(OBSERVED_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY clip_id, event_id ORDER BY ts) AS a, row_number() OVER (PARTITION BY clip_id, event_id ORDER BY ts DESC) AS z FROM ob),
s AS (SELECT clip_id, event_id, type, count(*) AS n, bool_and(inside) FILTER (a <= 2) AS ia, bool_and(inside) FILTER (z <= 2) AS iz, avg(CASE WHEN a <= 2 THEN gap END) AS ga, avg(CASE WHEN z <= 2 THEN gap END) AS gz FROM k GROUP BY ALL)
SELECT clip_id, event_id, type, CASE WHEN n >= 4 AND type = 'enter' AND ia AND NOT iz AND round(gz - ga, 9) >= 0.08 THEN 'exit' WHEN n >= 4 AND type = 'exit' AND iz AND NOT ia AND round(ga - gz, 9) >= 0.08 THEN 'enter' ELSE type END AS corrected FROM s""")
def direction_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.corrected_direction(_observed(track_view(spark, sf_dir)), ["clip_id", "event_id"])


@query(OBSERVED_SQL + """, m AS (SELECT *, sum((NOT inside)::INT) OVER w AS out_n, last_value(CASE WHEN NOT inside THEN gap END IGNORE NULLS) OVER w AS far FROM ob WINDOW w AS (PARTITION BY clip_id, event_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT DISTINCT clip_id, event_id FROM m WHERE inside AND out_n >= 2 AND far - gap > 0.1""")
def exit_motion_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.exit_cues(_observed(track_view(spark, sf_dir)), ["clip_id", "event_id"])


@query(MERGED_SQL + f""", c AS (SELECT me.clip_id, me.event_id, min(least(p.x1, v.x1)) AS x1, min(least(p.y1, v.y1)) AS y1, max(greatest(p.x2, v.x2)) AS x2, max(greatest(p.y2, v.y2)) AS y2
  FROM me JOIN tracks p ON p.clip_id = me.clip_id AND p.id = me.person_id AND p.kind = 'person' AND p.ts >= start_s AND p.ts < end_s JOIN tracks v ON v.clip_id = p.clip_id AND v.frame_index = p.frame_index AND v.id = me.vehicle_id AND v.kind <> 'person' GROUP BY ALL)
SELECT clip_id, event_id, round(greatest(0, x1 - (x2 - x1) * 0.1), 6) AS x1, round(greatest(0, y1 - (y2 - y1) * 0.1), 6) AS y1, round(least(720, x2 + (x2 - x1) * 0.1), 6) AS x2, round(least(540, y2 + (y2 - y1) * 0.1), 6) AS y2 FROM c""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track_view(spark, sf_dir)
    seen = tracks.together(_numbered(t), t, (F.col("p_ts") >= F.col("start_s")) & (F.col("p_ts") < F.col("end_s")))
    found = verify.crop_boxes(seen, ["clip_id", "event_id"], 0.1, 720.0, 540.0)
    return found.select("clip_id", "event_id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


BASE_SQL = f"""WITH {TRACKS}, l AS (SELECT clip_id, id, count(*) AS n, min(frame_index) AS ff, max(frame_index) AS fl, min(ts) AS tf, max(ts) AS tl FROM tracks WHERE kind = 'person' GROUP BY ALL HAVING count(*) >= 3),
fr AS (SELECT *, lag(scene) OVER w AS before, lead(scene) OVER w AS after FROM (SELECT DISTINCT clip_id, frame_index, scene FROM tracks) WINDOW w AS (PARTITION BY clip_id ORDER BY frame_index)),
tc AS (SELECT p.clip_id, p.frame_index, p.id, v.id AS vehicle_id FROM tracks p JOIN tracks v ON p.clip_id = v.clip_id AND p.frame_index = v.frame_index AND p.kind = 'person' AND v.kind <> 'person' WHERE {gap_sql()} <= 0),
al AS (SELECT l.clip_id, 'exit' AS type, l.id AS person_id, vehicle_id, tf AS start_s, least(least(tf + 1.5, tl), {DURATION}) AS end_s FROM l JOIN fr ON fr.clip_id = l.clip_id AND fr.frame_index = ff AND before = scene JOIN tc ON tc.clip_id = l.clip_id AND tc.frame_index = ff AND tc.id = l.id WHERE tf > 0.5 AND tf < {DURATION} - 0.5
  UNION ALL SELECT l.clip_id, 'enter', l.id, vehicle_id, greatest(tf, tl - 1.5), least(tl + 0.1, {DURATION}) FROM l JOIN fr ON fr.clip_id = l.clip_id AND fr.frame_index = fl AND after = scene JOIN tc ON tc.clip_id = l.clip_id AND tc.frame_index = fl AND tc.id = l.id WHERE tl > 0.5 AND tl < {DURATION} - 0.5)
SELECT clip_id, type, person_id, vehicle_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM al WHERE round(start_s, 6) < round(end_s, 6)"""


@query(BASE_SQL)
def geometry_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.geometry_baseline(track_view(spark, sf_dir), DURATION, 0.1)


@query(f"""WITH {SPANS}, c AS (SELECT clip_id, event_id, start_s, end_s, 80000.0 AS duration_s, vehicle_id * 1000 AS frame_count FROM spans),
f AS (SELECT clip_id, event_id, list_filter([CASE WHEN end_s > duration_s + 1e-6 THEN 'past the end' END, CASE WHEN event_id % 5000 >= frame_count THEN 'frame' END], lambda x: x IS NOT NULL) AS faults FROM c)
SELECT clip_id, event_id, array_to_string(faults, ',') AS faults FROM f WHERE len(faults) > 0""")
def clip_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that break a rule of the output schema, with the rules' names."""
    s = spans(spark, sf_dir).select("clip_id", "event_id", F.array(F.struct("start_s", "end_s")).alias("spans"), F.array(F.col("event_id") % 5000).alias("evidence_frames"), F.lit(80000.0).alias("duration_s"), (F.col("vehicle_id") * 1000).alias("frame_count"))
    return E.faults(s).withColumn("faults", F.array_join("faults", ","))


def _votes(s: DataFrame) -> DataFrame:
    """Ten events of a person and day are the ballots of a candidate."""
    return s.select("clip_id", "person_id", F.col("event_id").alias("ballot_id"), F.when(F.col("vehicle_id") < 7, "interaction").otherwise("no_interaction").alias("decision"), "type", F.when(F.col("vehicle_id") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array("slot", "vehicle_id")).alias("evidence_frames"))


@query(f"""WITH {SPANS}, v AS (SELECT clip_id, person_id, event_id AS b, vehicle_id < 7 AS yes, type, CASE WHEN vehicle_id % 3 = 0 THEN [] ELSE [slot, vehicle_id] END AS ev FROM spans),
s AS (SELECT clip_id, person_id, count(*) AS votes, count(*) FILTER (yes) AS positive FROM v GROUP BY ALL),
r AS (SELECT clip_id, person_id, max(m) AS longest FROM (SELECT clip_id, person_id, run, count(*) AS m FROM (SELECT *, row_number() OVER w - sum(yes::INT) OVER w AS run FROM v WINDOW w AS (PARTITION BY clip_id, person_id ORDER BY b)) WHERE yes GROUP BY ALL) GROUP BY ALL),
t AS (SELECT clip_id, person_id, type, count(*) AS m, list_sort(list_distinct(flatten(list(ev)))) AS evidence FROM v WHERE yes GROUP BY ALL),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, person_id ORDER BY m DESC, type) AS nth FROM t) WHERE nth = 1),
d AS (SELECT s.*, coalesce(longest, 0) AS longest, w.type AS wt, evidence, CASE WHEN NOT (positive / votes >= 0.6 AND coalesce(longest, 0) >= 2) THEN 'no_interaction' WHEN len(evidence) = 0 THEN 'uncertain' ELSE 'interaction' END AS decision FROM s LEFT JOIN r USING (clip_id, person_id) LEFT JOIN w USING (clip_id, person_id))
SELECT clip_id, person_id, votes, positive, longest, decision, CASE WHEN decision = 'interaction' THEN wt END AS type, CASE WHEN decision = 'interaction' THEN array_to_string(evidence, ',') END AS evidence FROM d""")
def vote_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verify.tally(_votes(spans(spark, sf_dir)), ["clip_id", "person_id"])
    return found.withColumn("evidence", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ","))


@query(f"""WITH {TRACKS}, s AS (SELECT clip_id, id, list(frame_index ORDER BY frame_index) AS fs FROM tracks WHERE kind = 'person' GROUP BY ALL),
i AS (SELECT DISTINCT clip_id, id, fs, floor(unnest(generate_series(0, 4)) * greatest(len(fs) - 6, 0) / 4)::BIGINT AS s FROM s) SELECT clip_id, id, array_to_string(fs[s + 1:s + 6], ',') AS ballot FROM i""")
def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = track_view(spark, sf_dir).where("kind = 'person'").groupBy("clip_id", "id").agg(F.sort_array(F.collect_list("frame_index")).alias("fs"))
    return frames.select("clip_id", "id", F.explode(verify.ballots(F.col("fs"))).alias("b")).select("clip_id", "id", F.array_join(F.transform("b", lambda x: x.cast("string")), ",").alias("ballot"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as a model might give them, some in a fence or a list, some broken."""
    s = spans(spark, sf_dir)
    event = F.format_string('{"type": "%s", "start_frame": %d, "end_frame": %d, "evidence_frames": [%d]}', "type", F.col("vehicle_id"), F.col("vehicle_id") + F.col("slot") % 3, F.col("vehicle_id") + F.col("slot") % 5)
    body = F.when(F.col("person_id") % 4 == 0, F.lit('{"decision": "no_interaction", "reason": "far", "events": []}')).when(F.col("person_id") % 7 == 0, F.lit('{"decision": ')).otherwise(F.concat(F.lit('{"decision": "interaction", "reason": "near", "events": ['), event, F.lit("]}")))
    return s.select(F.col("event_id").cast("string").alias("candidate_id"), F.when(F.col("vehicle_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("vehicle_id") == 3, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body).alias("answer"))


@query(f"""WITH {SPANS}, a AS (SELECT event_id::VARCHAR AS candidate_id, type, vehicle_id AS sf, vehicle_id + slot % 3 AS ef, vehicle_id + slot % 5 AS v, person_id FROM spans),
f AS (SELECT *, CASE WHEN person_id % 4 = 0 THEN 'none' WHEN person_id % 7 = 0 THEN 'broken' ELSE 'event' END AS shape FROM a),
g AS (SELECT candidate_id, shape, list_filter([CASE WHEN ef > 12 OR v > 12 THEN 'invented' END, CASE WHEN v > ef THEN 'outside' END], lambda x: x IS NOT NULL) AS faults FROM f)
SELECT candidate_id, CASE WHEN shape = 'none' THEN 'no_interaction' WHEN shape = 'event' AND len(faults) = 0 THEN 'interaction' ELSE 'uncertain' END AS decision,
CASE WHEN shape = 'none' THEN '' WHEN shape = 'broken' THEN 'unreadable' ELSE array_to_string(faults, ',') END AS fault FROM g""")
def decision_parse_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions after checking: what can't be read or breaks a rule is uncertain."""
    found = verify.accepted(_answers(spark, sf_dir), F.transform(F.sequence(F.lit(0), F.lit(12)), lambda x: x.cast("bigint")))
    return found.select("candidate_id", "decision", F.when(F.array_contains("faults", "unreadable"), "unreadable").otherwise(F.array_join("faults", ",")).alias("fault"))


@query("""WITH e AS (SELECT event_id, value, CASE WHEN event_id % 3 = 0 THEN '[' || props || ']' WHEN event_id % 5 = 0 THEN '[' || props || ',' || props || ']' ELSE props END AS j FROM events)
SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN (j->>'$[0].k')::BIGINT ELSE (j->>'$.k')::BIGINT END AS k FROM e""")
def json_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list with one element stands for the element; a longer one for nothing."""
    e, p = F.col("event_id"), F.col("props")
    j = F.when(e % 3 == 0, F.concat(F.lit("["), p, F.lit("]"))).when(e % 5 == 0, F.concat(F.lit("["), p, F.lit(","), p, F.lit("]"))).otherwise(p)
    return read(spark, sf_dir, "events").select("event_id", verify.parsed(j, "struct<k:bigint>")["k"].alias("k"))


@query(f"""WITH {SPANS}, p AS (SELECT event_id, type, 'p' || person_id AS pid, 'p' || slot AS oid, 'V' || vehicle_id AS vid FROM spans),
d AS (SELECT *, CASE WHEN type = 'exit' THEN 'Associated with the vehicle.' WHEN type = 'enter' THEN 'person ' || pid || ' is Wearing a ' || type || ' vest.' ELSE 'Tall' END AS pd,
  CASE event_id % 4 WHEN 0 THEN 'Vehicle ' || vid || ' is a Red van and appears to be a taxi.' WHEN 1 THEN 'vehicle associated with it' WHEN 2 THEN '' ELSE 'White ' || lower(vid) || ' truck' END AS vd FROM p),
t AS (SELECT *, regexp_replace(regexp_replace(rtrim(pd, '.'), '^Person\\s+' || pid || '\\s+is\\s+', '', 'i'), '^Person\\s+', '', 'i') AS a, regexp_replace(regexp_replace(rtrim(vd, '.'), '^Vehicle\\s+' || vid || '\\s+is\\s+(a\\s+)?', '', 'i'), '\\s+and\\s+appears\\s+to\\s+be\\s+(a\\s+)?', ' ', 'i') AS b FROM d),
u AS (SELECT *, 'Person ' || pid || CASE WHEN lower(a) LIKE 'associated with%' THEN '' ELSE ' ' || lower(a[1]) || substr(a, 2) END AS subject, CASE WHEN b = '' OR lower(b) LIKE 'vehicle associated%' THEN 'vehicle ' || vid ELSE lower(b[1]) || substr(b, 2) || CASE WHEN contains(lower(b), lower(vid)) THEN '' ELSE ' (' || vid || ')' END END AS object,
  CASE type WHEN 'enter' THEN 'enters' WHEN 'exit' THEN 'exits' WHEN 'load_unload' THEN 'loads or unloads' ELSE 'interacts with' END AS verb FROM t)
SELECT event_id, subject || CASE WHEN event_id % 5 = 0 THEN ' and Person ' || oid ELSE '' END || ' ' || verb || ' ' || object || '.' AS description FROM u""")
def description_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    pid, other, vid = F.concat(F.lit("p"), F.col("person_id")), F.concat(F.lit("p"), F.col("slot")), F.concat(F.lit("V"), F.col("vehicle_id"))
    person = F.when(F.col("type") == "exit", F.lit("Associated with the vehicle.")).when(F.col("type") == "enter", F.concat(F.lit("person "), pid, F.lit(" is Wearing a "), F.col("type"), F.lit(" vest."))).otherwise("Tall")
    nth = F.col("event_id") % 4
    vehicle = F.when(nth == 0, F.concat(F.lit("Vehicle "), vid, F.lit(" is a Red van and appears to be a taxi."))).when(nth == 1, "vehicle associated with it").when(nth == 2, "").otherwise(F.concat(F.lit("White "), F.lower(vid), F.lit(" truck")))
    people = F.when(F.col("event_id") % 5 == 0, F.array(X.person_phrase(person, pid), X.person_phrase(F.lit(None).cast("string"), other))).otherwise(F.array(X.person_phrase(person, pid)))
    return s.select("event_id", X.sentence(people, F.col("type"), X.vehicle_phrase(vehicle, vid)).alias("description"))


@query(f"""WITH {SPANS}, s AS (SELECT clip_id, count(*) FILTER (side = 0) / nullif(count(*) FILTER (type = 'enter'), 0) AS a, count(*) FILTER (side = 1) / nullif(count(*), 0) AS b FROM spans GROUP BY ALL)
SELECT clip_id, coalesce(printf('%.1f%%', a * 100), 'N/A') AS share, coalesce(printf('%+.1f pp', (a - b) * 100), 'N/A') AS change FROM s""")
def percent_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).groupBy("clip_id").agg(F.try_divide(F.count_if(F.col("side") == 0), F.count_if(F.col("type") == "enter")).alias("a"), F.try_divide(F.count_if(F.col("side") == 1), F.count("*")).alias("b"))
    return s.select("clip_id", X.percent(F.col("a")).alias("share"), X.delta_points(F.col("a"), F.col("b")).alias("change"))


@query("""SELECT event_id, sha256('{"event_type":"' || event_type || '","k":' || (props->>'$.k') || ',"user_id":' || user_id || '}') AS fingerprint FROM events""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of the canonical JSON of some columns."""
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select("event_id", X.fingerprint({"user_id": F.col("user_id"), "k": k, "event_type": F.col("event_type")}).alias("fingerprint"))


@query(f"""WITH {SPANS}, a AS (SELECT clip_id, type, count(*) AS n FROM spans WHERE side = 0 GROUP BY ALL), b AS (SELECT clip_id, type, count(*) AS n FROM spans WHERE side = 1 GROUP BY ALL)
SELECT coalesce(a.clip_id, b.clip_id) AS clip_id, coalesce(a.type, b.type) AS type, a.n AS before, b.n AS after FROM a FULL JOIN b ON a.clip_id = b.clip_id AND a.type = b.type WHERE a.n IS DISTINCT FROM b.n""")
def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose values differ between two sides, or that one side lacks."""
    s = spans(spark, sf_dir).groupBy("side", "clip_id", "type").agg(F.count("*").alias("n"))
    a, b = (s.where(F.col("side") == k).select("clip_id", "type", F.col("n").alias(n)) for k, n in ((0, "before"), (1, "after")))
    return a.join(b, ["clip_id", "type"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


@query(f"""WITH {SPANS}, m AS (SELECT clip_id, side, count(*) AS n, round(sum(end_s - start_s), 3) AS seconds FROM spans GROUP BY ALL)
SELECT a.clip_id, a.n AS n, b.n AS n_other, b.n - a.n AS n_change, round(b.seconds - a.seconds, 3) AS seconds_change FROM m a JOIN m b ON a.clip_id = b.clip_id AND a.side = 0 AND b.side = 1""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spans(spark, sf_dir).groupBy("clip_id", "side").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end_s") - F.col("start_s")), 3).alias("seconds"))
    b = m.where("side = 1").select("clip_id", F.col("n").alias("n_other"), F.col("seconds").alias("other"))
    return m.where("side = 0").join(b, "clip_id").select("clip_id", "n", "n_other", (F.col("n_other") - F.col("n")).alias("n_change"), F.round(F.col("other") - F.col("seconds"), 3).alias("seconds_change"))


@query("""WITH f AS (SELECT label, vec_id, unnest(generate_series(0, len(embedding) - 1)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, dim::INT AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(arg_max(x, vec_id) - arg_min(x, vec_id), 6) AS change FROM f GROUP BY ALL""")
def embedding_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.pooled(read(spark, sf_dir, "embeddings"), ["label"], "vec_id")


FAR_SQL = """WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
m AS (SELECT list(v ORDER BY d) AS m FROM (SELECT d, avg(x[d]) AS v FROM e, generate_series(1, (SELECT max(len(x)) FROM e)) g(d) GROUP BY d)),
c AS (SELECT vec_id, list_transform(generate_series(1, len(x)), lambda i: x[i] - m[i]) AS c FROM e, m),
u AS (SELECT vec_id, list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1e-12)) AS u FROM c),
n AS (SELECT list(v ORDER BY d) AS n FROM (SELECT d, avg(u[d]) AS v FROM u, generate_series(1, (SELECT max(len(u)) FROM u)) g(d) GROUP BY d)),
a AS (SELECT vec_id, u, round(list_sum(list_transform(generate_series(1, len(u)), lambda i: (u[i] - n[i]) * (u[i] - n[i]))), 9) AS away FROM u, n),
s AS (SELECT 1 AS k, [arg_min({'id': vec_id, 'u': u}, (-away, vec_id))] AS chosen FROM a
  UNION ALL SELECT k + 1, list_append(chosen, arg_min({'id': vec_id, 'u': u}, (near, vec_id))) FROM (
    SELECT s.k, s.chosen, u.vec_id, u.u, round(greatest(list_max(list_transform(s.chosen, lambda c: list_dot_product(c.u, u.u))), -2), 9) AS near FROM s CROSS JOIN u WHERE s.k < 8 AND NOT list_contains(list_transform(s.chosen, lambda c: c.id), u.vec_id)) GROUP BY k, chosen)
SELECT x.c.id AS vec_id, x.nth AS nth FROM (SELECT unnest(chosen) AS c, generate_subscripts(chosen, 1)::INT AS nth FROM s WHERE k = (SELECT max(k) FROM s)) x"""


@query(FAR_SQL)
def diverse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight far-apart vectors, in the order in which they are chosen."""
    e = read(spark, sf_dir, "embeddings")
    chosen = learning.diverse_sample(e, 8)
    return e.where(F.col("vec_id").isin(chosen)).select("vec_id", F.array_position(F.array(*[F.lit(c) for c in chosen]), F.col("vec_id")).alias("nth"))


@query()
def candidate_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best threshold of a logistic head, over folds that it was not fitted on."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") < 3).cast("int").alias("label"), (F.col("vec_id") % 3).alias("fold"))
    return learning.best_threshold(learning.head_scores(e, [0, 1, 2]))


HIST = "sqrt(greatest(0.0, 1 - list_sum(list_transform(generate_series(1, len({a})), lambda i: sqrt({a}[i] * {b}[i]))) / greatest(sqrt(list_sum({a}) * list_sum({b})), 1e-12)))"
SPLIT_SQL = f"""WITH f AS (SELECT vec_id // 25 AS track, vec_id % 25 AS fr, list_transform(embedding, lambda x: (x * x)::DOUBLE / list_sum(list_transform(embedding, lambda y: (y * y)::DOUBLE))) AS f FROM embeddings),
w AS (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY track) AS n, lead(f) OVER o AS f1, lead(f, 2) OVER o AS f2, lag(f) OVER o AS b1, lag(f, 2) OVER o AS b2, lead(fr) OVER o AS fr1 FROM f WINDOW o AS (PARTITION BY track ORDER BY fr)),
m AS (SELECT *, list_transform(generate_series(1, len(f)), lambda i: (b2[i] + b1[i] + f[i]) / 3) AS old, list_transform(generate_series(1, len(f)), lambda i: (f1[i] + f2[i]) / 2) AS new FROM w WHERE n >= 6 AND i BETWEEN 2 AND n - 3 AND fr1 - fr <= 2)
SELECT track, min(fr1) AS at_frame FROM m WHERE {HIST.format(a="f", b="f1")} >= 0.3 AND {HIST.format(a="old", b="new")} >= 0.2 AND {HIST.format(a="f1", b="f2")} <= 0.9 GROUP BY track"""


@query(SPLIT_SQL)
def appearance_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of vectors that change abruptly: the squares of each vector are its histogram."""
    e = read(spark, sf_dir, "embeddings")
    norm = F.aggregate(F.transform("embedding", lambda x: (x * x).cast("double")), F.lit(0.0), lambda s, x: s + x)
    f = e.select(F.floor(F.col("vec_id") / 25).alias("track"), (F.col("vec_id") % 25).alias("frame_index"), F.lit(1.0).alias("area"), F.transform("embedding", lambda x: (x * x).cast("double") / norm).alias("f"))
    return E.appearance_splits(f, ["track"], 0.3, 0.2, 0.9)


@query(f"""WITH sp AS ({SPLIT_SQL}) SELECT t.track, vec_id % 25 AS frame_index, t.track::VARCHAR || CASE WHEN vec_id % 25 >= at_frame THEN 'b' ELSE '' END AS id FROM (SELECT vec_id, vec_id // 25 AS track FROM embeddings) t LEFT JOIN sp ON sp.track = t.track""")
def split_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tracks, cut there: what comes after the change has another id."""
    e = read(spark, sf_dir, "embeddings").select(F.lit(0).alias("clip_id"), F.floor(F.col("vec_id") / 25).alias("id"), (F.col("vec_id") % 25).alias("frame_index"))
    cut = E.split_tracks(e, appearance_split(spark, sf_dir).select(F.lit(0).alias("clip_id"), F.col("track").alias("id"), "at_frame"), ["clip_id"])
    return cut.select(F.col("raw_id").cast("long").alias("track"), "frame_index", "id")


@query(f"""WITH {FRAMES}, c AS (SELECT frame, count(*) FILTER (kind = 'person') AS people, count(*) FILTER (kind <> 'person') AS vehicles FROM fo WHERE conf >= CASE WHEN kind = 'person' THEN 0.93 ELSE 0.95 END GROUP BY frame) SELECT * FROM c""")
def confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes above the threshold of their kind, counted by frame."""
    person = F.col("kind") == "person"
    kept = frames_objects(spark, sf_dir).where(F.col("conf") >= F.when(person, 0.93).otherwise(0.95))
    return kept.groupBy("frame").agg(F.count_if(person).alias("people"), F.count_if(~person).alias("vehicles"))
