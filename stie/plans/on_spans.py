"""Queries on the `spans` view: occupancy, merging, matching and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stie.functions import geometry as G
from stie.operators import evaluation as E
from stie.operators import intervals as I
from stie.sources.views import DAY, SPANS, TYPES, spans

QUERIES, ORACLES = {}, {}
LABELS = sorted(TYPES.values())
PAIR = ["clip_id", "type", "person_id", "vehicle_id"]
GROUP = ["clip_id"]
THRESHOLD = 0.3


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


UNION_SQL = """{name} AS (SELECT {keys}, min(start_s) AS start_s, max(end_s) AS end_s{more} FROM (
  SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start_s {op} max(end_s) OVER (PARTITION BY {keys} ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM {source}))
  GROUP BY {keys}, island)"""


def union_sql(name: str, keys: str, source: str = "spans", op: str = "<=", more: str = "") -> str:
    return UNION_SQL.format(name=name, keys=keys, source=source, op=op, more=more)


def occupancy_sql(keys: str) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""WITH {SPANS}, {union_sql("u", keys + ", side")},
l AS (SELECT {keys}, coalesce(sum(CASE WHEN side = 0 THEN end_s - start_s END), 0.0) AS predicted, coalesce(sum(CASE WHEN side = 1 THEN end_s - start_s END), 0.0) AS reference FROM u GROUP BY {keys}),
x AS (SELECT {", ".join("a." + k for k in keys.split(", "))}, sum(least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)) AS shared FROM u a JOIN u b ON {on} AND a.side = 0 AND b.side = 1 AND a.start_s < b.end_s AND b.start_s < a.end_s GROUP BY ALL),
j AS (SELECT l.*, coalesce(shared, 0.0) AS shared FROM l LEFT JOIN x USING ({keys})),
k AS (SELECT *, predicted + reference - shared AS union_s FROM j)"""


RATES_SQL = """round(predicted, 3) AS predicted, round(reference, 3) AS reference, round(shared, 3) AS shared, round(union_s, 3) AS union_s,
round(shared / nullif(predicted, 0), 6) AS precision, round(shared / nullif(reference, 0), 6) AS recall, round(shared / nullif(union_s, 0), 6) AS iou, round(2 * shared / nullif(predicted + reference, 0), 6) AS f1"""


@query(occupancy_sql("clip_id") + f""",
t AS (SELECT NULL::VARCHAR AS clip_id, sum(predicted) AS predicted, sum(reference) AS reference, sum(shared) AS shared, sum(union_s) AS union_s FROM k)
SELECT clip_id, {RATES_SQL} FROM (SELECT clip_id, predicted, reference, shared, union_s FROM k UNION ALL SELECT * FROM t)""")
def temporal_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that prediction and reference share, per clip and pooled (null clip)."""
    return I.pooled(I.occupancy(spans(spark, sf_dir), ["clip_id"]), ["clip_id"])


@query(occupancy_sql("clip_id, type") + f""",
t AS (SELECT NULL::VARCHAR AS clip_id, type, sum(predicted) AS predicted, sum(reference) AS reference, sum(shared) AS shared, sum(union_s) AS union_s FROM k GROUP BY type)
SELECT clip_id, type, {RATES_SQL} FROM (SELECT clip_id, type, predicted, reference, shared, union_s FROM k UNION ALL SELECT * FROM t)""")
def occupancy_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for each type; the unions are made within the type, and pooled over the clips."""
    return I.pooled(I.occupancy(spans(spark, sf_dir), ["clip_id", "type"]), ["clip_id", "type"], ["clip_id"])


@query(f"WITH {SPANS}, {union_sql('u', 'clip_id, side')} SELECT clip_id, side, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s FROM u")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.union(spans(spark, sf_dir), ["clip_id", "side"]).select("clip_id", "side", "start_s", "end_s")


#: Of a day's clip, an hour is a task's share.
HOUR = 3600.0


@query(f"WITH {SPANS}, {union_sql('u', 'clip_id')} SELECT clip_id, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s FROM u")
def union_by_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of all of a clip's spans, scanned hour by hour."""
    return I.union(spans(spark, sf_dir), ["clip_id"], HOUR).select("clip_id", "start_s", "end_s")


@query(occupancy_sql("clip_id") + f" SELECT clip_id, {RATES_SQL} FROM k")
def occupancy_by_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy per clip, swept hour by hour."""
    return I.pooled(I.occupancy(spans(spark, sf_dir), ["clip_id"], HOUR), ["clip_id"]).where("clip_id IS NOT NULL")


@query(f"WITH {SPANS}, {union_sql('u', 'clip_id, type, vehicle_id', op='<', more=', count(*) AS n_events')} SELECT * FROM u")
def merge_same_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge_overlapping(spans(spark, sf_dir), ["clip_id", "type", "vehicle_id"])


@query(f"""WITH {SPANS}, i AS (SELECT DISTINCT clip_id, unnest(generate_series(0, 86400 - 1, 3600)) AS t FROM spans)
SELECT i.clip_id, t::INT AS t, count(*) AS n, sum(event_id)::BIGINT AS ids FROM i JOIN spans s ON i.clip_id = s.clip_id AND t >= start_s AND t < end_s GROUP BY ALL""")
def active_events_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    instants = s.select("clip_id").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(86399), F.lit(3600))))
    return I.active_at(instants, s, ["clip_id"]).groupBy("clip_id", "t").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


SESSIONS_SQL = f"""WITH {SPANS}, s AS (SELECT vehicle_id, clip_id, min(start_s) AS start_s, max(start_s) AS end_s, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY clip_id, vehicle_id ORDER BY start_s ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, CASE WHEN start_s - lag(start_s) OVER (PARTITION BY clip_id, vehicle_id ORDER BY start_s) > 600 + 1e-9 THEN 1 ELSE 0 END AS fresh FROM spans)) GROUP BY clip_id, vehicle_id, session)"""


@query(SESSIONS_SQL + " SELECT clip_id, vehicle_id, start_s, end_s, n FROM s")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sessions(spans(spark, sf_dir), ["clip_id", "vehicle_id"], "start_s", 600.0).select("clip_id", "vehicle_id", "start_s", "end_s", "n")


@query(SESSIONS_SQL + """, p AS (SELECT clip_id, vehicle_id, greatest(0, start_s - 30) AS a, least(86400, end_s + 30) AS b FROM s),
w AS (SELECT *, unnest(generate_series(0, greatest(1, ceil((b - a - 120) / 480 - 1e-9))::BIGINT - 1)) AS k FROM p)
SELECT clip_id, vehicle_id, k::INT AS window_no, round(a + k * 480, 3) AS window_start, round(least(b, a + k * 480 + 600), 3) AS window_end FROM w""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.sessions(spans(spark, sf_dir), ["clip_id", "vehicle_id"], "start_s", 600.0)
    return I.sliding_windows(I.padded(found, 30.0, F.lit(86400.0)), 600.0, 120.0).select("clip_id", "vehicle_id", "window_no", "window_start", "window_end")


@query(f"""WITH {SPANS} SELECT a.clip_id, a.event_id, b.event_id AS other_id, round(least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s), 3) AS shared
FROM spans a JOIN spans b ON a.clip_id = b.clip_id AND a.vehicle_id = b.vehicle_id AND a.event_id < b.event_id AND a.start_s < b.end_s AND b.start_s < a.end_s""")
def interval_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).select("clip_id", "vehicle_id", "event_id", "start_s", "end_s")
    shared = F.round(G.overlap(F.col("start_s"), F.col("end_s"), F.col("r_start_s"), F.col("r_end_s")), 3)
    bounds, others = F.struct("start_s", "end_s"), F.struct("r_start_s", "r_end_s")
    # two spans meet in the order of their bounds, equal ones in that of their ids
    pairs = I.pairs_of_bounds(s, s, ["clip_id", "vehicle_id"], lambda p: p.where(bounds <= others).withColumns({"same": bounds == others, "shared": shared}))
    ids = F.least("event_id", "r_event_id").alias("event_id"), F.greatest("event_id", "r_event_id").alias("other_id")
    return pairs.where("event_id < r_event_id OR event_id > r_event_id AND NOT same").select("clip_id", *ids, "shared")


CANDIDATES_SQL = f"""{SPANS}, c AS (SELECT * FROM (SELECT a.clip_id, a.event_id AS p, b.event_id AS r,
  (least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)) / ((a.end_s - a.start_s) + (b.end_s - b.start_s) - (least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s))) AS tiou
  FROM spans a JOIN spans b ON a.clip_id = b.clip_id AND a.side = 0 AND b.side = 1 AND a.start_s < b.end_s AND b.start_s < a.end_s) WHERE tiou >= {THRESHOLD})"""


@query(f"WITH {CANDIDATES_SQL} SELECT clip_id, p AS event_id, r AS r_event_id, round(tiou, 6) AS tiou FROM c")
def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).select("clip_id", "event_id", "side", "start_s", "end_s")
    return E.match_candidates(s, GROUP, THRESHOLD, places=6).select("clip_id", "event_id", "r_event_id", "tiou")


def _matched(s: DataFrame, only_count: bool = False) -> DataFrame:
    return E.matched_spans(s.select("clip_id", "event_id", "type", "side", "start_s", "end_s"), GROUP, THRESHOLD, only_count=only_count)


#: The best matching of a whole clip is beyond SQL; tests find it on small tables by trying every assignment.
@query()
def matched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spans(spark, sf_dir)).groupBy("clip_id").agg(F.count("*").alias("n"), F.round(F.sum("tiou"), 6).alias("total"))


@query()
def event_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rates per clip and in all (null clip)."""
    s = spans(spark, sf_dir)
    per = E.counts(s, _matched(s, only_count=True), GROUP)  # any matching of the most pairs has the same counts
    sums = per.rollup("clip_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], (F.count("*") * DAY).alias("seconds"))
    return sums.select("clip_id", "tp", "fp", "fn", *[F.round(v, 6).alias(k) for k, v in E.rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("seconds")).items()])


@query()
def kpi_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per type, from a matching of its own in which the types must agree."""
    s = spans(spark, sf_dir)
    matched = E.matched_spans(s.select("clip_id", "event_id", "type", "side", "start_s", "end_s"), GROUP, THRESHOLD, typed=True, only_count=True)
    sides = s.groupBy("type").agg(F.count_if(F.col("side") == 0).alias("p"), F.count_if(F.col("side") == 1).alias("r"))
    tp = F.coalesce("tp", F.lit(0))
    return sides.join(matched.groupBy("type").agg(F.count("*").alias("tp")), "type", "left").select("type", tp.alias("tp"), (F.col("p") - tp).alias("fp"), (F.col("r") - tp).alias("fn"))


@query()
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    return E.confusion(s, _matched(s), LABELS)


@query()
def metric_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, rates and boundary errors at four thresholds, with and without types, in all, by clip and by type: one matching for all cases."""
    return E.metric_grid(spans(spark, sf_dir), GROUP, (0.3, 0.5, 0.7, 0.9))


@query()
def boundary_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.boundary_errors(_matched(spans(spark, sf_dir)))


@query(f"""WITH {SPANS}, r AS (SELECT * FROM spans WHERE side = 1) SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM spans p WHERE p.side = 0 AND p.clip_id = r.clip_id AND p.vehicle_id = r.vehicle_id
AND least(p.end_s, r.end_s) - greatest(p.start_s, r.start_s) >= 0.5 * (r.end_s - r.start_s))) AS covered FROM r""")
def proposal_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    return E.coverage(s.where("side = 0"), s.where("side = 1"), ["clip_id", "vehicle_id"])


@query(f"""WITH {SPANS}, n AS (SELECT * FROM spans WHERE side = 1 AND type = 'exit') SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM spans p WHERE p.side = 0 AND p.clip_id = n.clip_id AND p.vehicle_id = n.vehicle_id
AND p.start_s < n.end_s AND n.start_s < p.end_s)) AS hit FROM n""")
def encounter_fp_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    return E.encounters_hit(s.where("side = 1 AND type = 'exit'"), s.where("side = 0"), ["clip_id", "vehicle_id"])


@query(f"""WITH {SPANS}, d AS (SELECT clip_id, person_id AS pred_id, max(vehicle_id) + 1000 AS ref_id FROM spans WHERE side = 1 GROUP BY ALL)
SELECT s.clip_id, event_id, coalesce(ref_id, person_id) AS person_id FROM spans s LEFT JOIN d ON d.clip_id = s.clip_id AND pred_id = person_id WHERE side = 0""")
def entity_mapping_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    mapping = s.where("side = 1").groupBy("clip_id", F.col("person_id").alias("pred_id")).agg((F.max("vehicle_id") + 1000).alias("ref_id"))
    return E.mapped(s.where("side = 0").select("clip_id", "event_id", "person_id"), mapping, "person_id")


@query(f"""WITH {SPANS}, p AS (SELECT * FROM spans WHERE side = 0), x AS (SELECT p.event_id, list(r.event_id ORDER BY r.event_id) AS ids FROM p JOIN spans r ON r.side = 1 AND r.type = 'enter' AND p.clip_id = r.clip_id AND p.vehicle_id = r.vehicle_id
AND p.start_s < r.end_s AND r.start_s < p.end_s GROUP BY p.event_id) SELECT p.clip_id, p.event_id, coalesce(array_to_string(ids, ','), '') AS reviews FROM p LEFT JOIN x USING (event_id)""")
def review_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the reviews of the same vehicle that overlap it, in order."""
    s = spans(spark, sf_dir)
    events, reviews = s.where("side = 0"), s.where("side = 1 AND type = 'enter'")
    text = lambda ids: F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")
    numbered = events.withColumn("n", F.count("*").over(W.partitionBy("event_id")))
    once = I.with_overlapping(numbered.where("n = 1 AND event_id IS NOT NULL"), reviews, ["clip_id", "vehicle_id"], "ids").select("clip_id", "event_id", text("ids").alias("reviews"))
    # events of one id share their reviews
    again = numbered.where("n > 1 OR event_id IS NULL")
    pairs = I.overlapping_pairs(again, reviews, ["clip_id", "vehicle_id"])
    shared = again.select("clip_id", "event_id").join(pairs.groupBy("event_id").agg(text(F.sort_array(F.collect_list("r_event_id"))).alias("reviews")), "event_id", "left")
    return once.unionByName(shared.fillna("", ["reviews"]))


@query(f"""WITH {SPANS}, n AS (SELECT * FROM spans WHERE type = 'exit' AND side = 1) SELECT clip_id, event_id, 'kept' AS origin FROM spans WHERE side = 0
UNION ALL SELECT clip_id, event_id, 'added' FROM n WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE p.side = 0 AND p.clip_id = n.clip_id AND p.vehicle_id = n.vehicle_id AND p.start_s < n.end_s AND n.start_s < p.end_s)""")
def anti_join_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, plus the cues that no event of the same vehicle overlaps."""
    s = spans(spark, sf_dir)
    cues, events = s.where("type = 'exit' AND side = 1"), s.where("side = 0")
    hit = I.overlapping_pairs(cues, events, ["clip_id", "vehicle_id"]).select("event_id").distinct()
    added = cues.join(hit, "event_id", "left_anti").select("clip_id", "event_id", F.lit("added").alias("origin"))
    return events.select("clip_id", "event_id", F.lit("kept").alias("origin")).unionByName(added)


@query(f"""WITH {SPANS}, v AS (SELECT DISTINCT clip_id, person_id FROM spans WHERE side = 1 AND type = 'load_unload')
SELECT s.clip_id, s.event_id, CASE WHEN v.person_id IS NULL THEN 'verify' ELSE 'skip' END AS step FROM spans s LEFT JOIN v ON v.clip_id = s.clip_id AND v.person_id = s.person_id WHERE side = 0""")
def semi_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that an earlier run rejected are not verified again."""
    s = spans(spark, sf_dir)
    rejected = s.where("side = 1 AND type = 'load_unload'").select("clip_id", "person_id").distinct().withColumn("hit", F.lit(1))
    return s.where("side = 0").join(rejected, ["clip_id", "person_id"], "left").select("clip_id", "event_id", F.when(F.col("hit").isNull(), "verify").otherwise("skip").alias("step"))
