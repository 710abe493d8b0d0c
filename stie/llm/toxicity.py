"""Operator 2, toxicity: a factorization machine over hashed terms.

Terms are lower-case words and their beginnings of 4 to 7 letters' bytes, hashed into
2^18 slots. The slots that tell the labels apart best in the training sample are the
features (present or not). The score is
logistic(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), so a pair of terms can weigh what
neither does alone. The logit is shifted so that 0.5 is the cut with the best F1 on the
training rows.

The model is fitted on at most `rows` labelled documents (learning.py); it is a few hundred
kB and goes to the executors with the task. Null and empty texts get the score of a
text without terms. Without any training rows, or with one class only, the score is the
class's rate.

Long texts are read whole, in blocks. Rows that repeat get the same score each. A null doc_id is in the
held-out fold. An empty table gives an empty result. Columns other than doc_id, text and the label are
not read by the scoring; the filter passes all columns on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stie.llm import kernels as K
from stie.llm.common import table
from stie.llm.learning import labelled_sample, scored

U64 = np.uint64
SLOT_BITS = 18
ROWS = 20_000
BEGINNINGS = (4, 5, 6, 7)

LETTERS = np.ones(256, dtype=bool)  # what parts words: everything that isn't an ASCII letter or part of a longer character
LETTERS[128:] = False
LETTERS[ord("A") : ord("Z") + 1] = False
LETTERS[ord("a") : ord("z") + 1] = False


def term_slots(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of documents: first, last, and document and slot of every term, with repetitions."""
    buf, offsets = K.text_buffer(pc.utf8_lower(texts.cast(pa.large_string())))
    for i, j in K.blocks(offsets):
        part, bounds = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, doc = K.word_spans(part, bounds, LETTERS)
        sums = K.prefix_sums(K.BYTES[part])
        slots, docs = [K.range_hash(sums, start, end) ^ U64(1)], [doc]
        for n in BEGINNINGS:
            long = np.flatnonzero(end - start > n)
            slots.append(K.range_hash(sums, start[long], start[long] + n))
            docs.append(doc[long])
        yield i, j, np.concatenate(docs), (np.concatenate(slots) >> U64(64 - SLOT_BITS)).astype(np.int64)


def features(texts: pa.Array, lookup: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks of documents: first, last, and a matrix with 1 where a document has a feature."""
    width = int(lookup.max()) + 1 if len(lookup) else 0
    for i, j, doc, slot in term_slots(texts):
        chosen = lookup[slot]
        has = chosen >= 0
        doc, chosen = doc[has], chosen[has]
        for a in range(0, j - i, 1024):
            b = min(a + 1024, j - i)
            here = (doc >= a) & (doc < b)
            x = np.zeros((b - a, width), dtype=np.float32)
            x[doc[here] - a, chosen[here]] = 1
            yield i + a, i + b, x


@dataclass
class FactorizationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        pairs = ((x @ self.factors) ** 2 - (x**2) @ (self.factors**2)).sum(axis=1) / 2
        return self.bias + x @ self.weights + pairs

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, factors: int = 8, epochs: int = 30, batch: int = 256, rate: float = 0.02, decay: float = 1e-3, seed: int = 7) -> FactorizationMachine:
        """Adam on the logistic loss; x is 0 or 1. Both classes weigh the same in the gradient's square root."""
        rng = np.random.default_rng(seed)
        n, d = x.shape
        rare = y.mean()
        weight = np.where(y == 1, np.sqrt(0.5 / rare), np.sqrt(0.5 / (1 - rare))).astype(np.float32)
        state = {"bias": np.zeros(1, np.float32), "weights": np.zeros(d, np.float32), "factors": rng.normal(0, 0.02, (d, factors)).astype(np.float32)}
        first, second = ({k: np.zeros_like(v) for k, v in state.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(n)
            for p in range(0, n, batch):
                rows = order[p : p + batch]
                part = x[rows].astype(np.float32)
                sums = part @ state["factors"]
                pairs = (sums**2 - part @ (state["factors"] ** 2)).sum(axis=1) / 2
                z = state["bias"] + part @ state["weights"] + pairs
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)
                gradient = {
                    "bias": np.array([error.sum()]),
                    "weights": part.T @ error + decay / 10 * state["weights"],
                    "factors": part.T @ (error[:, None] * sums) - state["factors"] * (part.T @ error)[:, None] + decay * state["factors"],
                }
                step += 1
                for k, g in gradient.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    state[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return cls(float(state["bias"][0]), state["weights"], state["factors"])


def best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The logit between two training rows above which F1 is best; in the middle of the widest such gap's ends."""
    order = np.argsort(-logit, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    at = int(np.argmax(f1))
    z = logit[order]
    return float((z[at] + z[at + 1]) / 2) if at + 1 < len(z) else float(z[at] - 1)


@dataclass
class ToxicityModel:
    lookup: np.ndarray
    machine: FactorizationMachine
    cut: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for i, j, x in features(texts, self.lookup):
            out[i:j] = self.machine.logit(x) - self.cut
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_toxicity(documents: DataFrame, labels: DataFrame, target: str = "toxic", rows: int = ROWS, width: int = 1024, least: int = 3) -> ToxicityModel:
    sample = labelled_sample(documents, labels, target, rows)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for i, _, doc, slot in term_slots(batch.column(0)):
                once = np.unique(doc << SLOT_BITS | slot)
                slot, toxic = once & ((1 << SLOT_BITS) - 1), label[(once >> SLOT_BITS) + i] > 0
                n, ones = np.bincount(slot), np.bincount(slot[toxic])
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(np.append(ones, np.zeros(len(n) - len(ones), dtype=np.int64))[at])], ["slot", "n", "ones"])

    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0)).alias("ones")).first()
    rate = total.ones / total.n if total.n else 0.0
    nothing = FactorizationMachine(float(np.log((rate + 1e-6) / (1 - rate + 1e-6))), np.zeros(0, np.float32), np.zeros((0, 1), np.float32))
    if not 0 < rate < 1:
        return ToxicityModel(np.full(1 << SLOT_BITS, -1, dtype=np.int16), nothing, 0.0)
    deviation = (F.col("ones") - F.col("n") * rate) / F.sqrt(F.col("n") * F.lit(rate * (1 - rate)))
    chosen = (
        sample.select("text", "label").mapInArrow(counts, "slot long, n long, ones long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
        .where(F.col("n") >= least).orderBy(F.abs(deviation).desc(), "slot").limit(width).collect()
    )
    lookup = np.full(1 << SLOT_BITS, -1, dtype=np.int16)
    for k, row in enumerate(chosen):
        lookup[row.slot] = k

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in features(batch.column(2), lookup):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array([r.tobytes() for r in np.packbits(x > 0, axis=1)], pa.binary())], ["doc_id", "label", "bits"])

    if not chosen:
        return ToxicityModel(lookup, nothing, 0.0)
    got = sample.select("doc_id", "label", "text").mapInArrow(matrix, "doc_id long, label int, bits binary").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending"), ("bits", "ascending")])
    y = (got.column("label").to_numpy() > 0).astype(np.float32)
    bits = np.frombuffer(b"".join(got.column("bits").to_pylist()), np.uint8).reshape(len(y), -1)
    x = np.unpackbits(bits, axis=1, count=len(chosen))
    machine = FactorizationMachine.fit(x, y)
    logit = np.concatenate([machine.logit(x[p : p + 1024].astype(np.float32)) for p in range(0, len(x), 1024)])
    return ToxicityModel(lookup, machine, best_cut(logit, y))


def toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def score(texts: pa.Array, _) -> dict[str, pa.Array]:
        found = model.score(texts)
        return {"score": pa.array(found), "predicted": pa.array((found >= 0.5).astype(np.int32))}

    return scored(documents, score, "score double, predicted int")


def without_toxic(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents that the model doesn't reject, with their columns."""
    names, schema = documents.columns, documents.schema

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(names.index("text"))) < 0.5))

    return documents.mapInArrow(of_batches, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity(documents, fit_toxicity(documents, table(spark, sf_dir, "labels")))
