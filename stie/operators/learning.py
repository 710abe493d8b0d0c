"""Candidate classification: pooled embeddings, a standardised logistic head, folds, diverse samples."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stie.functions.geometry import overlap
from stie.operators.graph import reliable
from stie.operators.intervals import _buckets
from stie.operators.scan import Running, scanned
from stie.operators.verify import evenly


def pooled(vectors: DataFrame, keys: list[str], order: str, value: str = "embedding") -> DataFrame:
    """keys, dim, mean, std (of the population), change (last less first) of every component."""
    flat = vectors.select(*keys, order, F.posexplode(F.col(value)).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return flat.groupBy(*keys, "dim").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"), F.round(F.max_by("x", order) - F.min_by("x", order), 6).alias("change"))


def diverse_sample(vectors: DataFrame, k: int, key: str = "vec_id", value: str = "embedding") -> list[int]:
    """Keys of k rows, each the farthest (of centered vectors of length 1) from those before; the first is farthest from their mean.

    k rows come to the driver, one a pass; the vectors stay where they are.
    """
    size = vectors.select(F.size(value)).first()[0]
    means = vectors.select([F.avg(F.col(value)[i].cast("double")).alias(f"m{i}") for i in range(size)]).first()
    centered = F.zip_with(F.transform(value, lambda x: x.cast("double")), F.array(*[F.lit(m) for m in means]), lambda x, m: x - m)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = vectors.select(key, centered.alias("c")).withColumn("norm", F.sqrt(total(F.transform("c", lambda x: x * x))))
    rows = rows.withColumn("u", F.transform("c", lambda x: x / F.greatest(F.col("norm"), F.lit(1e-12)))).withColumn("near", F.lit(-2.0)).cache()
    middle = rows.select([F.avg(F.col("u")[i]).alias(f"m{i}") for i in range(size)]).first()
    away = total(F.zip_with("u", F.array(*[F.lit(m) for m in middle]), lambda x, m: (x - m) * (x - m)))
    chosen = [rows.orderBy(F.desc(F.round(away, 9)), key).first()]
    while len(chosen) < k:
        nearest: Column = F.greatest(*[total(F.zip_with("u", F.array(*[F.lit(x) for x in c.u]), lambda a, b: a * b)) for c in chosen], F.lit(-2.0))
        best = rows.where(~F.col(key).isin([c[key] for c in chosen])).orderBy(F.round(nearest, 9), key).first()
        if best is None:
            break
        chosen.append(best)
    rows.unpersist()
    return [c[key] for c in chosen]


def head_scores(rows: DataFrame, folds: list, features: str = "embedding", label: str = "label", fold: str = "fold") -> DataFrame:
    """fold, key columns, label, probability: each fold scored by a head that was fitted on the others."""
    data = rows.withColumn("_x", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    out = None
    for name in folds:
        train, test = data.where(F.col(fold) != name), data.where(F.col(fold) == name)
        scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(train)
        positive = train.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.5
        weighted = scaler.transform(train).withColumn("_w", F.when(F.col(label) == 1, 0.5 / max(positive, 1e-6)).otherwise(0.5 / max(1 - positive, 1e-6)))
        head = LogisticRegression(featuresCol="_z", labelCol=label, weightCol="_w", maxIter=30, regParam=0.01).fit(weighted)
        scored = head.transform(scaler.transform(test)).withColumn("probability", vector_to_array("probability")[1]).drop("_x", "_z", "rawPrediction", "prediction")
        out = scored if out is None else out.unionByName(scored)
    return out


def best_threshold(scored: DataFrame, points: int = 25, label: str = "label", low: float = 0.2, step: float = 0.025) -> DataFrame:
    """threshold, f1: the best of an even grid of thresholds from `low` to `high`; the highest of equals."""
    grid = scored.withColumn("threshold", F.explode(F.array(*[F.lit(low + i * step) for i in range(points)])))
    hit, real = F.col("probability") >= F.col("threshold"), F.col(label) == 1
    sums = grid.groupBy("threshold").agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"))
    return sums.select("threshold", (2 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1")).orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def spread_sample(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """At most n rows of each class, evenly spread over its order."""
    nth, m = F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1, F.count("*").over(W.partitionBy(by))
    ranked = rows.withColumns({"_i": nth, "_m": m})
    return ranked.where(evenly(F.col("_i"), F.col("_m"), n)).drop("_i", "_m")


def labelled(candidates: DataFrame, references: DataFrame, keys: list[str], least: float = 0.5, bucket: float = 600.0) -> DataFrame:
    """candidates with `label`: 1 if it shares at least that part of any reference's duration. Both: keys, start_s, end_s; candidates: candidate_id.

    They meet by time bucket, and a candidate looks no further than its first hit; what is dealt are spans, not pairs. A reference of no length is shared by all of its key.
    """
    span = F.struct(F.col("start_s").alias("a"), F.col("end_s").alias("b"))
    long = references.where((F.col("end_s") > F.col("start_s")) & F.lit(least > 0))
    around = long.withColumn("_bucket", F.explode(_buckets(F.col("start_s"), F.col("end_s"), bucket))).groupBy(*keys, "_bucket").agg(F.collect_list(span).alias("_near"))
    candidates, one = reliable(candidates), [*keys, "candidate_id"]
    shared = lambda r: overlap(F.col("start_s"), F.col("end_s"), r["a"], r["b"])
    met = candidates.withColumn("_bucket", F.explode(_buckets(F.col("start_s"), F.col("end_s"), bucket))).join(around, [*keys, "_bucket"])
    hit = met.where(F.exists("_near", lambda r: shared(r) >= least * (r["b"] - r["a"]))).select(*one).distinct().withColumn("_hit", F.lit(1))
    short = references.where((F.col("end_s") <= F.col("start_s")) | F.lit(least <= 0)).select(*keys).distinct().withColumn("_all", F.lit(1))
    found = candidates.join(hit, one, "left").join(short, keys, "left")
    return found.withColumn("label", F.coalesce("_hit", "_all", F.lit(0))).select(*candidates.columns, "label")


def without_uncertain(candidates: DataFrame, uncertain: DataFrame, keys: list[str], bucket: float = 3600.0) -> DataFrame:
    """The candidates that share no time with an uncertain span.

    Of the uncertain spans that begin before a candidate's end, the latest end tells: a running maximum over both, no pairs.
    """
    row = lambda df, at, end, whole: df.select(*keys, F.col(at).alias("_t"), end.cast("double").alias("_end"), whole.alias("_c"))
    whole = F.struct(*candidates.columns)
    none = F.lit(None).cast(candidates.select(whole.alias("x")).schema["x"].dataType)
    # at the same time, candidates come first: a span that begins where they end shares nothing
    both = row(candidates, "end_s", F.lit(None), whole).unionByName(row(uncertain.dropna(subset=keys).where("start_s < end_s"), "start_s", F.col("end_s"), none))
    begun = scanned(both, keys, F.col("_t"), bucket, _reach=Running("max", F.col("_end"), ("_t", F.col("_c").isNull())))
    clear = F.coalesce(F.col("_reach") <= F.col("_c.start_s"), F.lit(True)) | F.coalesce(F.col("_c.start_s") >= F.col("_c.end_s"), F.lit(True))
    return begun.where(F.col("_c").isNotNull() & clear).select("_c.*")
