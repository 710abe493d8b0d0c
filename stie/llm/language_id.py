"""Operator 3, language identification by nearest centroid.

A text is a unit vector of TF-IDF weights of its hashed byte 1- to 3-grams (whole text, lower
case, with one space for each run of other characters than letters). Each language has up to `clusters` centroids, found by spherical k-means on its own
sample. The prediction is the language of the nearest centroid by cosine. A text that is
farther from it than nearly all of that centroid's training texts (distance above `slack` times the
99th percentile) is `rejected`: a flag, since a learned language is to be
named for every text with a letter.

Only text and non-null language of documents outside the held-out fold are learned from: of every
language, however many there are, at most `per_language` documents, and about `rows` in all (but 20 of each),
in the order of a hash of the ids. Of rows with one id and language, one text is learned from.
The model (centroids and IDF, 32 kB a language) goes to the executors with the task.

Null texts and texts without a letter are `und` with score 0, as is everything if there is nothing
to learn from; such texts are not rejected. Long texts are read whole, in blocks. Rows that repeat
get the same result each; ties go to the centroid that comes first by language. An empty table gives an empty
result. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stie.llm import kernels as K
from stie.llm.common import held_out, reliable, table
from stie.llm.learning import ngram_counts, one_text, scored
from stie.llm.toxicity import LETTERS

DIMS = 2048
PER_LANGUAGE = 1000
ROWS = 20_000
LEAST = 20
LETTER = r"\p{L}"


def vectors(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks of documents with damped counts, log(1 + count). What isn't a letter counts as one space."""
    buf, offsets = K.text_buffer(pc.utf8_lower(texts.cast(pa.large_string())))
    gap = LETTERS[buf]
    keep = np.ones(len(buf), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    keep[offsets[:-1][offsets[:-1] < len(buf)]] = True
    offsets = np.append(0, np.cumsum(keep))[offsets]
    buf = np.where(gap, np.uint8(0x20), buf)[keep]
    for i, j, counts in ngram_counts(buf, offsets, DIMS):
        yield i, j, np.log1p(counts).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Centroids (unit vectors) and each row's centroid."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centers = x[[int(rng.integers(len(x)))]]
    while len(centers) < k:  # farthest first
        centers = np.vstack([centers, x[int(np.argmin((x @ centers.T).max(axis=1)))]])
    nearest = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        nearest = np.argmax(x @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, x)
        centers = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), centers)
    return centers, np.argmax(x @ centers.T, axis=1)


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    limits: np.ndarray
    languages: list[str]
    of: np.ndarray

    def predict(self, texts: pa.Array, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        names, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        if not self.languages:
            return names, score, rejected
        for i, j, x in vectors(texts):
            cosine = unit(x * self.idf) @ self.centroids.T
            best = np.argmax(cosine, axis=1)
            value = np.clip(cosine[np.arange(j - i), best], 0, 1)
            for n in np.flatnonzero(letters[i:j]):
                names[i + n] = self.languages[self.of[best[n]]]
                score[i + n] = value[n]
                rejected[i + n] = 1 - value[n] > self.limits[best[n]]
        return names, score, rejected


def fit_languages(documents: DataFrame, per_language: int = PER_LANGUAGE, rows: int = ROWS, clusters: int = 4, slack: float = 1.25) -> LanguageModel:
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER) & ~held_out()).select(F.col("doc_id").cast("long"), "lang", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 40)).alias("turn"))
    ids = reliable(usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")))
    most = min(per_language, max(LEAST, rows // max(1, ids.count())))
    # Of a language with many documents, only those whose hash is low can be among the first; twice as many as needed are expected.
    likely = F.col("turn").cast("double") * F.col("ids") <= F.lit(float(1 << 40)) * 2 * most
    first = usable.join(ids, "lang").where(likely).groupBy("lang", "doc_id", "turn").agg(F.lit(1).alias("one"))
    ranked = first.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("turn", "doc_id")))
    chosen = ranked.where(F.col("nth") <= most).select("doc_id", "lang")
    sample = one_text(documents.select(F.col("doc_id").cast("long"), "lang", "text").where(F.col("text").rlike(LETTER)).join(F.broadcast(chosen), ["doc_id", "lang"]), "lang").select("doc_id", "lang", "text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in vectors(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["doc_id", "lang", "x"])

    got = sample.mapInArrow(featurise, "doc_id long, lang string, x binary").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("x", "ascending")])
    lang = got.column("lang").to_pylist()
    if not lang:
        return LanguageModel(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0), [], np.zeros(0, np.int64))
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(len(lang), DIMS).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(1)
    x = unit(x * idf)
    names = sorted(set(lang))
    number = np.searchsorted(names, lang)
    centroids, limits, of = [], [], []
    for n in range(len(names)):
        own = x[number == n]
        centers, nearest = spherical_kmeans(own, clusters)
        for c, center in enumerate(centers):
            distance = 1 - own[nearest == c] @ center
            centroids.append(center)
            limits.append(slack * float(np.quantile(distance, 0.99)) if len(distance) else 1.0)
            of.append(n)
    return LanguageModel(idf, np.array(centroids, np.float32), np.array(limits), names, np.array(of))


def identify_languages(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine), rejected of every document."""

    def score(texts: pa.Array, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        letters = batch.column(3).fill_null(False).to_numpy(zero_copy_only=False)
        names, value, rejected = model.predict(texts, letters)
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(value.astype(np.float64)), "rejected": pa.array(rejected)}

    return scored(documents, score, "lang_pred string, score double, rejected boolean", [F.col("text").rlike(LETTER).alias("letters")])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify_languages(documents, fit_languages(documents))
