"""Tracks: validity, near pairs, assignment, candidate windows, summaries, as-of lookups.

tracks: clip_id, frame_index, ts, scene, id, kind, x1, y1, x2, y2, conf. A frame is (clip_id,
frame_index); all joins between boxes are on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stie.functions import geometry as G
from stie.operators import intervals as I
from stie.operators.folds import fold, held_vehicle, picked
from stie.operators.graph import reliable
from stie.operators.grid import CORNERS, meeting
from stie.operators.nearest import Rule, best_pairs
from stie.operators.scan import Running, scanned

FRAME = ["clip_id", "frame_index"]


def pairs(objects: DataFrame, frame: list[str], name: str = "id") -> DataFrame:
    """Every person with every vehicle of its frame; columns p_..., v_..."""
    side = lambda kind, prefix: objects.where(kind).select(*frame, *[F.col(c).alias(prefix + c) for c in objects.columns if c not in frame])
    return side(F.col("kind") == "person", "p_").join(side(F.col("kind") != "person", "v_"), frame)


def near_pairs(objects: DataFrame, frame: list[str], margin: float, crowded: bool = True) -> DataFrame:
    """The pairs whose gap is at most a share of the vehicle's longer side. Where frames are known to hold few boxes, all their pairs cost less than a grid."""
    near = G.near(G.Box.of("p_"), G.Box.of("v_"), margin)
    if not crowded:
        return pairs(objects.dropna(subset=CORNERS), frame).where(near)
    return meeting(objects, frame, F.col("kind") == "person", F.col("kind") != "person", G.Box.of().side * margin, near)


def nearest(near: DataFrame, by: list[str], rank: list[Column]) -> DataFrame:
    """One row for each `by`: the first by rank."""
    return near.withColumn("_nth", F.row_number().over(W.partitionBy(*by).orderBy(*rank))).where("_nth = 1").drop("_nth")


def summaries(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, first_ts, last_ts of every track."""
    return tracks.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def valid_tracks(tracks: DataFrame, keys: list[str], least: int, seconds: float) -> DataFrame:
    return summaries(tracks, keys).where((F.col("n") >= least) & (F.col("last_ts") - F.col("first_ts") >= seconds - 1e-9))


def short_exceptions(tracks: DataFrame, keys: list[str], least: int = 2, aspect: float = 0.85, ends: int = 2, margin: float = 0.2) -> DataFrame:
    """keys, n, aspect: tracks whose upper-median aspect is upright and that touch a vehicle in one of their first or last frames."""
    people = tracks.where("kind = 'person'").withColumn("aspect", G.Box.of().aspect)
    shape = people.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("aspect")).alias("all"))
    shape = shape.withColumn("aspect", F.element_at("all", (F.col("n") / 2).cast("int") + 1)).drop("all").where((F.col("n") >= least) & (F.col("aspect") >= aspect))
    by = W.partitionBy(*keys)
    at_end = (F.row_number().over(by.orderBy("ts")) <= ends) | (F.row_number().over(by.orderBy(F.desc("ts"))) <= ends)
    edges = people.withColumn("edge", at_end).where("edge").select(*FRAME, "id").distinct()
    ends_ = people.join(edges, [*FRAME, "id"], "left_semi").select(*FRAME, "id", *CORNERS, "conf")
    touching = best_pairs(ends_, tracks.where("kind <> 'person'").select(*FRAME, "id", *CORNERS, "conf"), FRAME, Rule(margin, 0.0, 0.0)).select(*FRAME, F.col("p_id").alias("id")).distinct()
    hit = edges.join(touching, [*FRAME, "id"]).select(*keys).distinct()
    return shape.join(hit, keys, "left_semi")


def ranked(tracks: DataFrame, margin: float = 0.2, center_weight: float = 0.2, confidence_weight: float = 0.02, body: bool = False, **more: float) -> DataFrame:
    """clip_id, frame_index, ts, scene, person_id, vehicle_id, rank of all near pairs.

    Whether a person has several vehicles is found before the pairs are made, so they go out as they come: what is shuffled are boxes.
    """
    if not body:
        return ranks(near_pairs(tracks, FRAME, margin), center_weight, confidence_weight)
    rule = Rule(margin, center_weight, confidence_weight, True, **more)
    boxes = narrow(tracks)
    several = best_ranked(boxes, rule).where("p_several").select(*FRAME, F.col("person_id").alias("id"), F.lit("person").alias("kind"), F.lit(True).alias("several")).distinct()
    told = boxes.join(several, [*FRAME, "id", "kind"], "left")
    near = near_pairs(told, FRAME, margin).withColumn("p_several", F.coalesce("p_several", F.lit(False)))
    return near.select(*FRAME, F.col("p_ts").alias("ts"), F.col("p_scene").alias("scene"), F.col("p_id").alias("person_id"), F.col("v_id").alias("vehicle_id"), rule.rank(F.col("p_several")).alias("rank"))


def together(pairs_: DataFrame, boxes: DataFrame, when: Column) -> DataFrame:
    """Rows of a person and a vehicle with the boxes of both, by their ids, in the frames that have both and in which `when` holds of p_ts; columns p_..., v_..."""
    side = lambda kind, name, p: boxes.where(kind).select(*FRAME, F.col("id").alias(name), *[F.col(c).alias(p + c) for c in boxes.columns if c not in (*FRAME, "id")])
    return pairs_.join(side("kind = 'person'", "person_id", "p_"), ["clip_id", "person_id"]).where(when).join(side("kind <> 'person'", "vehicle_id", "v_"), [*FRAME, "vehicle_id"])


def ranks(near: DataFrame, center_weight: float = 0.2, confidence_weight: float = 0.02, body: bool = False, **more: float) -> DataFrame:
    """The same of near pairs, columns p_..., v_...; more: the numbers of the body rule."""
    rank = lambda several: F.round(G.vehicle_rank(G.Box.of("p_"), G.Box.of("v_"), F.col("p_conf"), F.col("v_conf"), F.lit(several), center_weight, confidence_weight, body, **more), 9)
    found = near.select(*FRAME, F.col("p_ts").alias("ts"), F.col("p_scene").alias("scene"), F.col("p_id").alias("person_id"), F.col("v_id").alias("vehicle_id"), rank(False).alias("rank"), *([rank(True).alias("_of_several")] if body else []))
    if not body:
        return found
    several = F.count("*").over(W.partitionBy(*FRAME, "person_id")) >= 2
    return found.withColumn("rank", F.when(several, F.col("_of_several")).otherwise(F.col("rank"))).drop("_of_several")


def assigned(near: DataFrame, max_gap: float = 1.0, switch_margin: float = 0.05, hold: bool = False) -> DataFrame:
    """One vehicle for each frame and person, with hysteresis along the person's track."""
    step = lambda c: held_vehicle(c["ts"], c["vehicle_id"], c["rank"], max_gap, switch_margin, hold)
    rows = near.select("clip_id", "frame_index", "ts", "scene", "person_id", "vehicle_id", "rank")
    return picked(rows, ["clip_id", "person_id"], ["ts", "rank", "vehicle_id"], step, ["ts", "vehicle_id", "rank"])


def best_ranked(boxes: DataFrame, rule: Rule) -> DataFrame:
    """The ranked near pairs among which is every person's best in its frame, with the boxes as p_..., v_...; a frame's other pairs are never made."""
    found = best_pairs(boxes.where("kind = 'person'").drop("kind"), boxes.where("kind <> 'person'").select(*FRAME, "id", *CORNERS, "conf"), FRAME, rule, ["clip_id", "p_id"])
    return found.withColumn("rank", rule.rank(F.col("p_several"))).withColumnsRenamed({"p_ts": "ts", "p_scene": "scene", "p_id": "person_id", "v_id": "vehicle_id"})


#: Frames that a chase looks ahead at first; then always so many times as many.
AHEAD, FASTER = 2, 4
#: Lookups of a round up to this many go to where the boxes lie; more of them are dealt with the boxes.
FEW_LOOKUPS = 400_000


def chased(boxes: DataFrame, best: DataFrame, rule: Rule, max_gap: float = 1.0, switch_margin: float = 0.05, hold: bool = False) -> DataFrame:
    """best (see best_ranked), and what else hysteresis may ask for: clip_id, frame_index, ts, scene, person_id, vehicle_id, rank.

    A vehicle that isn't the best can only be held if it was the best in a frame before and has been near and nearly as good
    since. So where a person's best one changes, the one before is looked up by its id, in frame after frame, until it is lost or is the
    best again: rows grow with the frames, not with the pairs. Each round looks further ahead, so rounds grow with the logarithm of a hold.
    """
    who, pair = ["clip_id", "person_id"], [*FRAME, "ts", "scene", "person_id", "vehicle_id", "rank"]
    here = W.partitionBy(*who, "ts").orderBy("rank", "vehicle_id")
    body = [c for c in best.columns if c.startswith("p_")]
    before = W.partitionBy(*who).orderBy("k").rangeBetween(-1, -1)
    placed = best.dropna(subset=who).withColumns({"k": F.dense_rank().over(W.partitionBy(*who).orderBy("ts")), "best": F.first("vehicle_id").over(here), "low": F.first("rank").over(here)})
    # a frame that is in the table twice has a person's box twice
    nth = F.row_number().over(W.partitionBy(*who, "ts", "scene", "frame_index", *body).orderBy("rank", "vehicle_id"))
    placed = reliable(placed.withColumns({"was": F.first("best").over(before), "since": F.first("ts").over(before), "nth": nth}).select(*pair, "k", "nth", "best", "low", "was", "since", *body))
    frames = placed.where("nth = 1").drop("vehicle_id", "rank", "nth")
    vehicles = boxes.where("kind <> 'person'").select(*FRAME, F.col("id").alias("vehicle_id"), *[F.col(c).alias(f"v_{c}") for c in [*CORNERS, "conf"]])
    turns = frames.where((F.col("was") != F.col("best")) & (F.col("ts") - F.col("since") <= max_gap + 1e-9)).withColumns({"turn": F.col("k"), "vehicle_id": F.col("was")})
    near, rank = rule.near(G.Box.of("p_"), G.Box.of("v_")), rule.rank(F.col("p_several"))
    if hold:
        found = _chased_over_gaps(turns, frames, vehicles, near, rank, max_gap, switch_margin)
    else:
        found = _chased_unbroken(turns, frames, vehicles, near & (rank <= F.col("low") + switch_margin), rank, max_gap)
    whole = placed.select(*pair)
    for part in found:
        whole = whole.unionByName(part.select(*pair))
    return whole


def _chased_unbroken(turns: DataFrame, frames: DataFrame, vehicles: DataFrame, good: Column, rank: Column, max_gap: float) -> list[DataFrame]:
    """Vehicles as long as they are good in every frame: what isn't good isn't kept, so only the first lookup is of as many rows as there are turns."""
    one, told = ["clip_id", "person_id", "turn", "vehicle_id"], [*FRAME, "ts", "scene", "person_id", "turn", "k", "vehicle_id"]
    soon = F.col("ts") - F.col("since") <= max_gap + 1e-9
    seen = lambda steps, beside: steps.join(beside(vehicles), [*FRAME, "vehicle_id"]).where(good & soon & (F.col("best") != F.col("vehicle_id"))).select(*told, rank.alias("rank"))
    kept = reliable(seen(turns, lambda v: v))
    found, last, ahead = [kept], kept, AHEAD
    while n := (chase := last.select(*one, "k").distinct()).count():
        few = n * ahead <= FEW_LOOKUPS
        steps = chase.withColumn("at", F.col("k")).withColumn("k", F.explode(F.sequence(F.col("k") + 1, F.col("k") + ahead)))
        steps = (F.broadcast(steps) if few else steps).join(frames, ["clip_id", "person_id", "k"])
        kept = seen(F.broadcast(steps) if few else steps, lambda v: v)
        kept = reliable(kept.join(F.broadcast(chase.withColumnRenamed("k", "at")) if few else chase.withColumnRenamed("k", "at"), one))
        leading = F.dense_rank().over(W.partitionBy(*one).orderBy("k"))
        kept = kept.withColumn("nth", leading).where(F.col("k") - F.col("at") == F.col("nth"))
        found.append(kept.drop("nth"))
        last = kept.where(F.col("nth") == ahead)
        ahead *= FASTER
    return found


def _chased_over_gaps(turns: DataFrame, frames: DataFrame, vehicles: DataFrame, near: Column, rank: Column, max_gap: float, switch_margin: float) -> list[DataFrame]:
    """Vehicles that may be missing for a while."""
    who, found, ahead = ["clip_id", "person_id"], [], AHEAD
    frames = frames.drop("was", "since")
    chase = reliable(turns.select(*who, "turn", "k", "vehicle_id", "since"))
    while not chase.isEmpty():
        steps = chase.withColumn("k", F.explode(F.sequence(F.col("k"), F.col("k") + ahead - 1))).join(frames, [*who, "k"])
        seen = steps.join(vehicles, [*FRAME, "vehicle_id"], "left")
        seen = seen.withColumn("near", F.coalesce(F.col("v_x1").isNotNull() & near, F.lit(False))).withColumn("rank", F.when(F.col("near"), rank))
        good = F.coalesce(F.col("rank") <= F.col("low") + switch_margin, F.lit(False))
        one = [*who, "turn", "vehicle_id"]
        # a frame that is in the table twice counts as good if one of its boxes is
        at = seen.groupBy(*one, "k").agg(F.first("since").alias("since"), F.first("ts").alias("ts"), F.max(good).alias("good"), F.max("near").alias("near"), F.first("best").alias("best"))
        before = W.partitionBy(*one).orderBy("k").rowsBetween(W.unboundedPreceding, -1)
        since = F.greatest("since", F.max(F.when(F.col("good"), F.col("ts"))).over(before))
        over = (F.col("ts") - since > max_gap + 1e-9) | (F.col("best") == F.col("vehicle_id")) | (F.col("near") & ~F.col("good"))
        ends = at.withColumn("over", over).groupBy(*one).agg(F.min(F.when(F.col("over"), F.col("k"))).alias("end"), F.greatest(F.first("since"), F.max(F.when(F.col("good"), F.col("ts")))).alias("since"), F.max("k").alias("k"))
        ends = reliable(ends)
        held = seen.drop("since").join(ends.select(*one, "end"), one).where(F.col("near") & (F.col("best") != F.col("vehicle_id")) & (F.col("k") <= F.coalesce("end", "k")))
        found.append(reliable(held.select(*FRAME, "ts", "scene", "person_id", "vehicle_id", "rank")))
        chase = ends.where("end IS NULL").select(*who, "turn", (F.col("k") + 1).alias("k"), "vehicle_id", "since")
        ahead *= FASTER
    return found


def assigned_best(boxes: DataFrame, rule: Rule = Rule(), max_gap: float = 1.0, switch_margin: float = 0.05, hold: bool = False) -> DataFrame:
    """assigned(ranked(boxes)), for which only each person's best vehicles and the lookups of chased() are made."""
    boxes = narrow(boxes)
    return assigned(chased(boxes, best_ranked(boxes, rule), rule, max_gap, switch_margin, hold), max_gap, switch_margin, hold)


def narrow(boxes: DataFrame) -> DataFrame:
    """What pairing needs of the boxes, made once."""
    return reliable(boxes.select(*FRAME, "ts", "scene", "id", "kind", *CORNERS, "conf"))


def candidate_sessions(assigned_: DataFrame, gap: float = 1.0) -> DataFrame:
    return I.sessions(assigned_, ["clip_id", "person_id", "vehicle_id", "scene"], "ts", gap)


def dominant_vehicle(tracks: DataFrame, before: float) -> DataFrame:
    """clip_id, vehicle_id: the vehicle with the greatest total area in the first seconds; the least id of equals."""
    areas = tracks.where((F.col("kind") != "person") & (F.col("scene") == 0) & (F.col("ts") < before)).groupBy("clip_id", F.col("id").alias("vehicle_id")).agg(F.round(F.sum(G.Box.of().area), 6).alias("area"))
    return nearest(areas, ["clip_id"], [F.desc("area"), F.col("vehicle_id")])


def velocities(tracks: DataFrame, keys: list[str], last: int = 4) -> DataFrame:
    """keys, n, vx, vy over the last observations of every track; 0 where time doesn't pass."""
    tail = tracks.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("ts")))).where(F.col("_nth") <= last)
    cx, cy = G.Box.of().center
    tail = tail.select(*keys, "ts", cx.alias("cx"), cy.alias("cy"))
    s = tail.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by(F.struct("ts", "cx", "cy"), "ts").alias("a"), F.max_by(F.struct("ts", "cx", "cy"), "ts").alias("b"))
    dt = F.col("b.ts") - F.col("a.ts")
    speed = lambda c: F.when(dt > 0, (F.col(f"b.{c}") - F.col(f"a.{c}")) / dt).otherwise(0.0)
    return s.select(*keys, "n", F.round(speed("cx"), 6).alias("vx"), F.round(speed("cy"), 6).alias("vy"))


def stitch_candidates(tracklets: DataFrame, gap: float = 0.5, reach: float = 1.0, cosine: float = 0.0) -> DataFrame:
    """Pairs of an ended and a later begun tracklet that may be one person.

    tracklets: clip_id, scene, id, first_ts, last_ts, first_x, first_y, last_x, last_y, side, vx, vy, first_vehicle, last_vehicle.
    """
    old = tracklets.select("clip_id", "scene", F.col("last_vehicle").alias("vehicle"), F.col("id").alias("old_id"), "last_ts", "last_x", "last_y", "side", "vx", "vy")
    new = tracklets.select("clip_id", "scene", F.col("first_vehicle").alias("vehicle"), F.col("id").alias("new_id"), "first_ts", "first_x", "first_y")
    step = F.round(F.col("first_ts") - F.col("last_ts"), 6)
    # a new one stands in its own bucket of time and an old one also in the next two (rounding), so they meet only those around them
    old = old.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("last_ts") / gap), F.floor(F.col("last_ts") / gap) + 2)))
    new = new.withColumn("_bucket", F.floor(F.col("first_ts") / gap))
    both = old.join(new, ["clip_id", "scene", "vehicle", "_bucket"]).withColumn("gap_s", step).where((F.col("old_id") != F.col("new_id")) & (F.col("gap_s") > 0) & (F.col("gap_s") <= gap))
    dx, dy = F.col("first_x") - F.col("last_x"), F.col("first_y") - F.col("last_y")
    off = F.sqrt(F.pow(dx - F.col("vx") * F.col("gap_s"), 2) + F.pow(dy - F.col("vy") * F.col("gap_s"), 2)) / F.greatest("side", F.lit(1.0))
    norm = F.sqrt(F.pow("vx", F.lit(2)) + F.pow("vy", F.lit(2))) * F.sqrt(dx * dx + dy * dy)
    along = F.when(norm > 0, (F.col("vx") * dx + F.col("vy") * dy) / norm).otherwise(1.0)
    return both.select("clip_id", "old_id", "new_id", "gap_s", F.round(off, 6).alias("distance"), F.round(along, 6).alias("cosine")).where((F.col("distance") <= reach) & (F.col("cosine") >= cosine))


def greedy_one_to_one(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Takes stitch candidates by (distance, gap, -cosine, old, new), each id once a side."""

    def step(rows: list[dict]):
        olds, news = set(), set()
        for row in rows:
            if row["old_id"] not in olds and row["new_id"] not in news:
                olds.add(row["old_id"])
                news.add(row["new_id"])
                yield row

    ordered = edges.withColumn("_against", -F.col("cosine"))
    schema = ", ".join(f"{n} {t}" for n, t in edges.dtypes)
    return fold(ordered, keys, ["distance", "gap_s", "_against", "old_id", "new_id"], step, schema)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, how: str = "nearest", bucket: float | None = None) -> DataFrame:
    """left with the right row that is nearest in time, or the last at or before (`backward`), the last before (`before`), or the first at or after (`forward`); of two equally near, the earlier.

    Both sides are sorted together once by key and time, so the cost doesn't grow with the pairs; with a bucket (of the time's
    unit), the rows of one key go to many tasks.
    """
    names = [c for c in right.columns if c not in keys]
    packed = F.struct(*names)
    l = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_r"))
    r = right.select(*keys, F.col(other).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_l"), packed.alias("_r"))
    found = {
        "_back": Running("last", F.col("_r"), ("_t", "_side")),
        "_before": Running("last", F.col("_r"), ("_t", F.desc("_side"))),
        "_ahead": Running("last", F.col("_r"), (F.desc("_t"), "_side"), backwards=True),
    }
    needed = {"nearest": ("_back", "_ahead"), "backward": ("_back",), "before": ("_before",), "forward": ("_ahead",)}[how]
    both = l.unionByName(r)
    both = scanned(both if bucket is None else reliable(both), keys, F.col("_t"), bucket, **{n: found[n] for n in needed}).where("_side = 1")
    if how == "nearest":
        closer = F.round(F.col(f"_ahead.{other}") - F.col("_t"), 9) < F.round(F.col("_t") - F.col(f"_back.{other}"), 9)
        chosen = F.when(F.col("_back").isNull(), F.col("_ahead")).when(F.col("_ahead").isNull(), F.col("_back")).when(closer, F.col("_ahead")).otherwise(F.col("_back"))
    else:
        chosen = F.col(needed[0])
    return both.select("_l.*", chosen.alias("_c")).select(*left.columns, *[F.col(f"_c.{n}").alias(n if n not in left.columns else f"r_{n}") for n in names])


def visibility_changes(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Frames whose set of ids differs from the frame before."""
    frames = tracks.groupBy(*keys, "frame_index").agg(F.array_join(F.transform(F.sort_array(F.collect_set("id")), lambda x: x.cast("string")), ",").alias("ids"))
    before = F.lag("ids").over(W.partitionBy(*keys).orderBy("frame_index"))
    return frames.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col("ids"))).drop("before")


def scene_numbers(frames: DataFrame, keys: list[str], difference: str, limit: float = 55.0) -> DataFrame:
    """Counts cuts: the scene goes up where the picture differs from the one before by more than `limit`."""
    order = W.partitionBy(*keys).orderBy("frame_index").rowsBetween(W.unboundedPreceding, 0)
    return frames.withColumn("scene_no", F.sum(F.when(F.col(difference) > limit, 1).otherwise(0)).over(order))


def longest_runs(rows: DataFrame, keys: list[str], at: str, positive: Column) -> DataFrame:
    """keys, longest: the most positive rows in a row."""
    order = W.partitionBy(*keys).orderBy(at)
    marked = rows.withColumn("_p", positive.cast("int")).withColumn("_run", F.row_number().over(order) - F.sum("_p").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = marked.groupBy(*keys, "_run").agg(F.sum("_p").alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest"))


def edge_means(values: DataFrame, keys: list[str], at: str, value: str, most: int = 3) -> DataFrame:
    """keys, n, first_mean, last_mean over the first and last min(most, n div 2) rows."""
    by = W.partitionBy(*keys)
    n = F.count("*").over(by)
    ranked_ = values.withColumns({"_n": n, "_a": F.row_number().over(by.orderBy(at)), "_z": F.row_number().over(by.orderBy(F.desc(at)))})
    k = F.least(F.lit(most), F.floor(F.col("_n") / 2))
    return ranked_.groupBy(*keys).agg(F.max("_n").alias("n"), F.round(F.avg(F.when(F.col("_a") <= k, F.col(value))), 6).alias("first_mean"), F.round(F.avg(F.when(F.col("_z") <= k, F.col(value))), 6).alias("last_mean"))
