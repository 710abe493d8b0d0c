"""Interval algebra: unions, merges, overlaps, sessions, windows and exclusive segments.

Every function takes a DataFrame with `start_s`, `end_s` (half-open) and key columns, and works
within the keys, so that all joins are hash joins with an interval predicate on top.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stie.functions import geometry as G
from stie.operators.graph import reliable
from stie.operators.scan import Running, scanned


def _islands(spans: DataFrame, keys: list[str], touching: bool, bucket: float | None = None) -> DataFrame:
    """Numbers the groups of spans that overlap, or also touch."""
    order = ("start_s", "end_s")
    reach = F.col("start_s") <= F.col("_reach") if touching else F.col("start_s") < F.col("_reach")
    begun = scanned(spans, keys, F.col("start_s"), bucket, _reach=Running("max", F.col("end_s"), order, own=False)).withColumn("_opens", F.when(reach, 0).otherwise(1)).drop("_reach")
    if bucket is not None:
        begun = reliable(begun)  # else what made the spans would be made again for each total
    return scanned(begun, keys, F.col("start_s"), bucket, island=Running("sum", F.col("_opens"), (*order, F.desc("_opens")))).drop("_opens")  # of equal spans, the one that opens comes first


def union(spans: DataFrame, keys: list[str], bucket: float | None = None) -> DataFrame:
    """keys, start_s, end_s: the union of the spans; touching ones merge. With a bucket (seconds), one key's spans go to many tasks."""
    return _islands(spans, keys, True, bucket).groupBy(*keys, "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("island")


def merge_overlapping(events: DataFrame, keys: list[str], *more: Column, bucket: float | None = None) -> DataFrame:
    """keys, start_s, end_s, n_events: events of one key merge where they strictly overlap; touching ones stay apart."""
    return _islands(events, keys, False, bucket).groupBy(*keys, "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n_events"), *more).drop("island")


def active_at(instants: DataFrame, spans: DataFrame, keys: list[str], at: str = "t", bucket: float = 3600.0) -> DataFrame:
    """Instants with the spans they fall into, start included and end not. They meet by time bucket."""
    held = spans.withColumn("_bucket", F.explode(_buckets(F.col("start_s"), F.col("end_s"), bucket)))
    return instants.withColumn("_bucket", F.floor(F.col(at) / bucket)).join(held, [*keys, "_bucket"]).where((F.col(at) >= F.col("start_s")) & (F.col(at) < F.col("end_s"))).drop("_bucket")


def _buckets(start: Column, end: Column, bucket: float) -> Column:
    return F.sequence(F.floor(start / bucket), F.greatest(F.floor(end / bucket), F.floor(start / bucket)))


def overlapping_pairs(left: DataFrame, right: DataFrame, keys: list[str], strict: bool = True, bucket: float = 3600.0) -> DataFrame:
    """All pairs within the keys that overlap; the right side's columns get the prefix r_.

    Both sides stand in every time bucket that they reach into, and a pair counts in that of the later start: so
    spans meet only those around them, however long the clip is.
    """
    right = right.select(*[F.col(c) if c in keys else F.col(c).alias(f"r_{c}") for c in right.columns])
    left = left.withColumn("_bucket", F.explode(_buckets(F.col("start_s"), F.col("end_s"), bucket)))
    right = right.withColumn("_bucket", F.explode(_buckets(F.col("r_start_s"), F.col("r_end_s"), bucket)))
    meets = (F.col("start_s") < F.col("r_end_s")) & (F.col("r_start_s") < F.col("end_s"))
    meets = meets if strict else (F.col("start_s") <= F.col("r_end_s")) & (F.col("r_start_s") <= F.col("end_s"))
    return left.join(right, [*keys, "_bucket"]).where(meets & (F.floor(F.greatest("start_s", "r_start_s") / bucket) == F.col("_bucket"))).drop("_bucket")


#: Spans of a side that one task holds of a key's bucket; a bucket with more is cut. Left spans of equal bounds that lie in one row: a task makes TOGETHER x HELD pairs before it passes them on.
HELD, TOGETHER = 50_000, 8


def _cut(sides: list[DataFrame], keys: list[str]) -> list[DataFrame]:
    """Both sides, standing in buckets, with columns _l and _r: a bucket of more than HELD spans of a side is cut, and each part of the left meets each of the right."""
    same = sides[0] is sides[1]
    stand = [s.select(*keys, "_bucket", *[F.lit(int(same or i == k)).alias(f"_in_{k}") for k in (0, 1)]) for i, s in enumerate(sides)]
    parts = [F.ceil(F.sum(f"_in_{k}") / HELD).cast("int").alias(f"_parts_{k}") for k in (0, 1)]
    # a row for HELD spans at most
    heavy = F.broadcast((stand[0] if same else stand[0].unionByName(stand[1])).groupBy(*keys, "_bucket").agg(*parts).where("_parts_0 > 1 OR _parts_1 > 1"))
    out = []
    for i, side in enumerate(sides):
        own, other = (F.greatest(F.coalesce(f"_parts_{k}", F.lit(1)), F.lit(1)) for k in (i, 1 - i))
        names = ("_l", "_r") if i == 0 else ("_r", "_l")
        mine = F.pmod(F.xxhash64(*side.columns), own).cast("int")
        out.append(side.join(heavy, [*keys, "_bucket"], "left").select(*side.columns, mine.alias(names[0]), F.explode(F.sequence(F.lit(0), other - 1)).alias(names[1])))
    return out


def pairs_of_bounds(left: DataFrame, right: DataFrame, keys: list[str], judged: Callable[[DataFrame], DataFrame], bucket: float = 3600.0) -> DataFrame:
    """overlapping_pairs for where the pairs themselves are asked for: spans of a side that have equal bounds lie together until the end.

    So what depends on keys and bounds only is judged once for all of them: `judged` gets a DataFrame of keys, start_s, end_s, r_start_s and r_end_s, and may add
    columns and drop rows. What is dealt are spans; pairs are made last, row by row, and are neither sorted nor sent.
    """
    bounds, at = ("start_s", "end_s"), [*keys, "_bucket", "_l", "_r"]
    named = [[f"{prefix}{c}" for c in side.columns if c not in keys] for prefix, side in (("", left), ("r_", right))]

    def alike(side: DataFrame, prefix: str) -> DataFrame:
        own = [F.col(c).alias(f"{prefix}{c}") for c in side.columns if c not in (*at, *bounds)]
        members = F.collect_list(F.struct(*own or [F.lit(0).alias(f"{prefix}_none")])).alias(f"_{prefix}members")
        return side.repartition(*at).groupBy(*at, *[F.col(c).alias(f"{prefix}{c}") for c in bounds]).agg(members)

    in_buckets = lambda s: s.withColumn("_bucket", F.explode(_buckets(F.col("start_s"), F.col("end_s"), bucket)))
    placed = in_buckets(left)
    left, right = _cut([placed, placed if right is left else in_buckets(right)], keys)
    few = F.transform(F.sequence(F.lit(1), F.size("_members"), F.lit(TOGETHER)), lambda i: F.slice("_members", i, TOGETHER))
    meets = (F.col("start_s") < F.col("r_end_s")) & (F.col("r_start_s") < F.col("end_s")) & (F.floor(F.greatest("start_s", "r_start_s") / bucket) == F.col("_bucket"))
    met = alike(left, "").withColumn("_members", F.explode(few)).join(alike(right, "r_").hint("merge"), at).where(meets)
    found = judged(met.drop("_bucket", "_l", "_r"))
    more = [c for c in found.columns if c not in (*keys, "_members", "_r_members", *named[0], *named[1])]
    for members in ("_members", "_r_members"):
        found = found.select(*[c for c in found.columns if c != members], F.inline(members))
    return found.select(*keys, *named[0], *named[1], *more)


def with_overlapping(spans: DataFrame, others: DataFrame, keys: list[str], name: str, shortest: float = 3600.0) -> DataFrame:
    """spans with a column `name`: the event ids of the others of the same keys that strictly overlap them, in order.

    A span stands in one place, by its start, in buckets that are at least as long as it is (the shortest ones, or twice, four times... as long), and
    the others in every such bucket that they may reach. So what is dealt are spans and not pairs, and a list is made where its span lies.
    """
    level = F.greatest(F.ceil(F.log2((F.col("end_s") - F.col("start_s")) / shortest) + 1e-9), F.lit(0)).cast("int")
    wide = F.pow(F.lit(2.0), F.col("_level")) * shortest
    placed = spans.withColumn("_level", level).withColumn("_bucket", F.floor(F.col("start_s") / wide))
    reach = F.sequence(F.floor(F.col("start_s") / wide) - 1, F.greatest(F.floor(F.col("end_s") / wide), F.floor(F.col("start_s") / wide) - 1))
    around = others.crossJoin(F.broadcast(placed.select("_level").dropna().distinct())).withColumn("_bucket", F.explode(reach))
    near = around.groupBy(*keys, "_level", "_bucket").agg(F.sort_array(F.collect_list(F.struct("event_id", "start_s", "end_s"))).alias("_near"))
    met = F.filter("_near", lambda o: (o["start_s"] < F.col("end_s")) & (F.col("start_s") < o["end_s"]))
    ids = F.coalesce(F.transform(met, lambda o: o["event_id"]), F.array().cast(f"array<{others.schema['event_id'].dataType.simpleString()}>"))
    return placed.join(near, [*keys, "_level", "_bucket"], "left").select(*spans.columns, ids.alias(name))


def occupancy(spans: DataFrame, keys: list[str], bucket: float | None = None) -> DataFrame:
    """keys, predicted, reference, shared, union_s in seconds. spans has side 0 (predicted) and 1 (reference).

    One sweep over the bounds of both sides, counted up and down: no pair of spans is made. With a bucket (seconds), one key's
    bounds go to many tasks.
    """
    bounds = spans.where("start_s < end_s").select(*keys, "side", F.explode(F.array(F.struct(F.col("start_s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_s").alias("t"), F.lit(-1).alias("d")))).alias("b"))
    at = bounds.groupBy(*keys, F.col("b.t").alias("t")).agg(*[F.sum(F.when(F.col("side") == s, F.col("b.d")).otherwise(0)).alias(n) for s, n in ((0, "dp"), (1, "dr"))])
    later = {"_next": Running("last", F.col("t"), (F.desc("t"),), own=False, backwards=True)}
    swept = scanned(at if bucket is None else reliable(at), keys, F.col("t"), bucket, **{n: Running("sum", F.col(f"d{n}"), ("t",)) for n in ("p", "r")}, **later)
    sweep = swept.select(*keys, (F.col("_next") - F.col("t")).alias("step"), *[(F.col(n) > 0).alias(n) for n in ("p", "r")])
    seconds = lambda on, name: F.coalesce(F.sum(F.when(on, F.col("step"))), F.lit(0.0)).alias(name)
    p, r = F.col("p"), F.col("r")
    return sweep.groupBy(*keys).agg(seconds(p, "predicted"), seconds(r, "reference"), seconds(p & r, "shared"), seconds(p | r, "union_s"))


def rates(shared: Column, predicted: Column, reference: Column, union_s: Column) -> dict[str, Column]:
    """Precision, recall, IoU and F1; null where undefined."""
    return {"precision": F.try_divide(shared, predicted), "recall": F.try_divide(shared, reference), "iou": F.try_divide(shared, union_s), "f1": F.try_divide(2 * shared, predicted + reference)}


def pooled(per_key: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """per_key and, under a null in `within` (all keys by default), the rates of the summed seconds."""
    within = keys if within is None else within
    fixed = [k for k in keys if k not in within]
    values = [F.sum(c).alias(c) for c in ("predicted", "reference", "shared", "union_s")]
    total = (per_key.groupBy(*fixed) if fixed else per_key).agg(*values)
    for k in within:
        total = total.withColumn(k, F.lit(None).cast(per_key.schema[k].dataType))
    both = per_key.unionByName(total)
    return both.select(*keys, *[F.round(c, 3).alias(c) for c in ("predicted", "reference", "shared", "union_s")], *[F.round(v, 6).alias(k) for k, v in rates(*(F.col(c) for c in ("shared", "predicted", "reference", "union_s"))).items()])


def sessions(points: DataFrame, keys: list[str], at: str, limit: float, *more: Column) -> DataFrame:
    """keys, start_s, end_s, n: runs of points; a new one begins where the step exceeds the limit (an equal one doesn't)."""
    order = W.partitionBy(*keys).orderBy(at)
    step = F.col(at) - F.lag(at).over(order)
    numbered = points.withColumn("_new", F.when(step > limit + 1e-9, 1).otherwise(0)).withColumn("session", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "session").agg(F.min(at).alias("start_s"), F.max(at).alias("end_s"), F.count("*").alias("n"), *more)


def padded(spans: DataFrame, context: float, duration: Column) -> DataFrame:
    return spans.withColumns({"start_s": F.greatest(F.lit(0.0), F.col("start_s") - context), "end_s": F.least(duration, F.col("end_s") + context)})


def sliding_windows(spans: DataFrame, window: float, overlap: float) -> DataFrame:
    """Each span cut into windows of one length and overlap, the last ending with the span."""
    step = window - overlap
    count = F.greatest(F.lit(1), F.ceil((F.col("end_s") - F.col("start_s") - overlap) / step - 1e-9)).cast("int")
    cut = spans.withColumn("window_no", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("start_s") + F.col("window_no") * step
    return cut.withColumns({"window_start": F.round(start, 3), "window_end": F.round(F.least(F.col("end_s"), start + window), 3)})


def cut_to(events: DataFrame, bounds: DataFrame, keys: list[str], first: str | None = None, last: str | None = None) -> DataFrame:
    """Events cut to begin at or after `first` and end at or before `last` of their key; the empty ones go, as do those whose key has no bounds."""
    joined = events.join(bounds, keys)
    start = F.greatest("start_s", first) if first else F.col("start_s")
    end = F.least("end_s", last) if last else F.col("end_s")
    return joined.withColumns({"start_s": start, "end_s": end}).where(F.col("start_s") < F.col("end_s"))
