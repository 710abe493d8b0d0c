"""Operator 6, quality: ordinal cumulative-link regression on graded ratings.

P(grade > k) = logistic(w.x - t_k), with one weight vector for all grades and thresholds
t_0 < t_1 < ... (kept in order as a first value and positive steps). x is the unit vector
of damped counts of hashed byte 1- to 3-grams of the whole text. Out come the expected grade and the
probability of a grade of at least `select`, by which documents are selected.

The ratings can have any number of grades; they are read as 0, 1, 2, ... in their order. The model is
fitted on at most `rows` rated documents outside the held-out fold (learning.py), and is a
few kB. Null and empty texts are scored by the thresholds alone. With one grade only, or no
rated rows, every document gets that grade (or 0) and a tail of 1.

Long texts are read whole, in blocks. Rows that repeat get the same result each. A null doc_id is in the
held-out fold. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stie.llm import kernels as K
from stie.llm.common import table
from stie.llm.learning import labelled_sample, ngram_counts, scored

DIMS = 2048
ROWS = 8_000


def vectors(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    buf, offsets = K.text_buffer(texts)
    for i, j, counts in ngram_counts(buf, offsets, DIMS):
        x = np.log1p(counts).astype(np.float32)
        yield i, j, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class OrdinalModel:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold."""
        return _logistic((x @ self.weights)[:, None] - self.thresholds)

    @classmethod
    def fit(cls, x: np.ndarray, rating: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 0.05, decay: float = 1e-5, seed: int = 3) -> OrdinalModel:
        """Adam on the likelihood of the grades."""
        grades = sorted({int(g) for g in rating})
        level = np.searchsorted(grades, rating)
        k = len(grades) - 1
        state = np.zeros(x.shape[1] + k)
        if not k:
            return cls(grades, state[: x.shape[1]], np.zeros(0))
        share = [(level > i).mean() for i in range(k)]
        first = np.log((1 - share[0]) / share[0])
        gaps = np.diff([np.log((1 - s) / s) for s in share])
        state[x.shape[1] :] = [first, *np.log(np.maximum(gaps, 1e-3))]
        rng, one, two, step = np.random.default_rng(seed), np.zeros_like(state), np.zeros_like(state), 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for p in range(0, len(x), batch):
                rows = order[p : p + batch]
                part, own = x[rows], level[rows]
                steps = np.exp(state[x.shape[1] + 1 :])
                cuts = state[x.shape[1]] + np.append(0, np.cumsum(steps))
                z = (part @ state[: x.shape[1]])[:, None] - cuts
                tail = np.hstack([np.ones((len(rows), 1)), _logistic(z), np.zeros((len(rows), 1))])
                slope = tail * (1 - tail)
                at = np.arange(len(rows))
                chance = np.maximum(tail[at, own] - tail[at, own + 1], 1e-9)
                d_cut = np.zeros((len(rows), k + 2))  # of -log(chance) to the z of each threshold
                d_cut[at, own] -= slope[at, own] / chance
                d_cut[at, own + 1] += slope[at, own + 1] / chance
                d_cut = d_cut[:, 1:-1] / len(rows)
                by_cut = -d_cut.sum(axis=0)
                gradient = np.concatenate([part.T @ d_cut.sum(axis=1) + decay * state[: x.shape[1]], [by_cut.sum()], np.cumsum(by_cut[::-1])[::-1][1:] * steps])
                step += 1
                one += 0.1 * (gradient - one)
                two += 0.001 * (gradient**2 - two)
                state -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
        return cls(grades, state[: x.shape[1]].astype(np.float32), state[x.shape[1]] + np.append(0, np.cumsum(np.exp(state[x.shape[1] + 1 :]))))


def fit_quality(documents: DataFrame, labels: DataFrame, target: str = "quality", rows: int = ROWS) -> OrdinalModel:
    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in vectors(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["doc_id", "label", "x"])

    sample = labelled_sample(documents, labels, target, rows).select("doc_id", "label", "text")
    got = sample.mapInArrow(featurise, "doc_id long, label int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending"), ("x", "ascending")])
    if not got.num_rows:
        return OrdinalModel([0], np.zeros(DIMS, np.float32), np.zeros(0))
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(got.num_rows, DIMS).astype(np.float32)
    return OrdinalModel.fit(x, got.column("label").to_numpy())


def quality(documents: DataFrame, model: OrdinalModel, select: int | None = None, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail, selected of every document; `select` is the highest grade if not given."""
    wanted = model.grades[-1] if select is None else select
    cut = sum(g < wanted for g in model.grades) - 1

    def score(texts: pa.Array, _) -> dict[str, pa.Array]:
        expected, tail = np.empty(len(texts)), np.ones(len(texts))
        steps = np.diff(model.grades)
        for i, j, x in vectors(texts):
            tails = model.tails(x)
            expected[i:j] = model.grades[0] + tails @ steps
            if cut >= 0:
                tail[i:j] = tails[:, cut] if cut < len(steps) else 0.0
        return {"expected_grade": pa.array(expected), "tail": pa.array(tail), "selected": pa.array(tail >= least)}

    return scored(documents, score, "expected_grade double, tail double, selected boolean")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality(documents, fit_quality(documents, table(spark, sf_dir, "labels")))
