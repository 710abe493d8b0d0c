"""The fitted and seeded operators against plain versions that try everything."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stie.llm import decontaminate, language_id, quality, toxicity
from stie.llm.common import held_out, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_factorization_machine_is_a_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = toxicity.FactorizationMachine(0.3, rng.normal(size=12).astype(np.float32), rng.normal(size=(12, 3)).astype(np.float32))
    x = (rng.random((20, 12)) < 0.4).astype(np.float32)
    for row, got in zip(x, machine.logit(x), strict=True):
        z = machine.bias + sum(w for w, on in zip(machine.weights, row, strict=True) if on)
        z += sum(float(machine.factors[i] @ machine.factors[j]) for i, j in itertools.combinations(np.flatnonzero(row), 2))
        assert got == pytest.approx(z, abs=1e-4)


def test_toxicity_of_the_tables_on_the_held_out_fold(spark, sf):
    large = f"{sf}/../sf0.1"  # the smallest table has one toxic document in this fold
    documents, labels = table(spark, large, "documents"), table(spark, large, "labels")
    model = toxicity.fit_toxicity(documents, labels)
    rows = toxicity.toxicity(documents, model).where("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    hits = sum(r.toxic and r.predicted for r in rows)
    bad, called = sum(r.toxic for r in rows), sum(r.predicted for r in rows)
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in rows if a.toxic for b in rows if not b.toxic]
    assert bad > 20 and hits >= 0.8 * bad and hits >= 0.9 * called and sum(pairs) / len(pairs) >= 0.95
    # What the operator says is what the model says of each text alone.
    texts = [r.text for r in documents.orderBy("doc_id").limit(40).collect()]
    alone = [float(model.score(pa.array([t], pa.string()))[0]) for t in texts]
    assert np.allclose(model.score(pa.array(texts, pa.string())), alone, atol=1e-5)


def plain_vector(text):
    """Damped counts of hashed byte 1- to 3-grams, gram by gram."""
    data = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower())
    data = bytes(b for i, b in enumerate(data.encode()) if not (b == 32 and i and data.encode()[i - 1] == 32))
    counts = np.zeros(language_id.DIMS)
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            code = 0
            for b in data[i : i + n]:
                code = (code * 257 + b + 1) & 0xFFFFFFFF
            counts[((code * (0x9E3779B1 * n & 0xFFFFFFFF | 1) & 0xFFFFFFFF) >> 8) % language_id.DIMS] += 1
    return np.log1p(counts)


def test_languages_are_those_of_the_nearest_centroid(spark, sf):
    documents = table(spark, sf, "documents")
    model = language_id.fit_languages(documents)
    rows = documents.where("text IS NOT NULL AND length(text) BETWEEN 20 AND 2000").orderBy("doc_id").limit(30).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_languages(documents, model).collect()}
    for r in rows:
        x = plain_vector(r.text) * model.idf
        cosine = [float(x @ c) / max(np.linalg.norm(x), 1e-12) for c in model.centroids]
        name, score = got[r.doc_id]
        assert name in {model.languages[model.of[k]] for k, v in enumerate(cosine) if v >= max(cosine) - 1e-5}
        assert score == pytest.approx(max(cosine), abs=1e-4)
    held = documents.where(held_out() & F.col("lang").isNotNull()).select("doc_id", "lang").collect()
    assert sum(got[r.doc_id][0] == r.lang for r in held if got[r.doc_id][0] != "und") >= 0.9 * sum(got[r.doc_id][0] != "und" for r in held)


def test_no_language_and_no_row_is_left_out_of_learning(spark):
    """Three hundred languages, and an id that very many rows have."""
    rows = [(1000 * k + i, f"word{k} " + f"{chr(97 + k % 26)}{chr(97 + k // 26)}" * 30, f"l{k:03d}", "s", 1) for k in range(300) for i in range(8)]
    hot = [(next(i for i in range(500_000, 500_099) if __import__("zlib").crc32(str(i).encode()) % 5), "word0 aa" * 9, "l000", "s", 1)] * 2000
    model = language_id.fit_languages(spark.createDataFrame(rows + hot, DOCS))
    assert len(model.languages) == 300


def likelihood(x, level, weights, cuts):
    total = 0.0
    for row, g in zip(x, level, strict=True):
        z = float(row @ weights)
        tail = [1.0, *(1 / (1 + math.exp(-(z - c))) for c in cuts), 0.0]
        total += math.log(max(tail[g] - tail[g + 1], 1e-12))
    return total / len(x)


def test_ordinal_regression_finds_the_most_likely_weights():
    """At the fitted point, no small step of a weight or threshold is better by more than the optimiser's noise."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    level = np.digitize(x @ [1.5, -1.0, 0.5, 0.0] + rng.logistic(size=600), [-1.0, 0.5, 2.0])
    model = quality.OrdinalModel.fit(x, level, epochs=150)
    best = likelihood(x, level, model.weights, model.thresholds)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    for i in range(7):
        for step in (-0.3, 0.3):
            weights, cuts = model.weights.astype(float).copy(), model.thresholds.copy()
            if i < 4:
                weights[i] += step
            else:
                cuts[i - 4] += step
            assert likelihood(x, level, weights, sorted(cuts)) < best
    tails = model.tails(x[:50])
    for row, t in zip(x, tails, strict=False):
        assert list(t) == pytest.approx([1 / (1 + math.exp(-(float(row @ model.weights) - c))) for c in model.thresholds], abs=1e-5)


def plain_tokens(text):
    return "".join(c if (c.isascii() and c.isalnum()) or ord(c) > 127 else " " for c in text.lower()).split()


def plain_contamination(docs, items, overlap=20, identity=0.8, shortest=11):
    found = set()
    for (d, a), (i, b) in itertools.product(docs, items):
        a, b = plain_tokens(a or ""), plain_tokens(b or "")
        w = min(len(b), overlap)
        need = w if len(b) < shortest else next(n for n in range(w + 1) if n >= identity * w)
        if w and any(sum(x == y for x, y in zip(a[p : p + w], b[q : q + w], strict=True)) >= need for p in range(len(a) - w + 1) for q in range(len(b) - w + 1)):
            found.add((d, i))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_contamination_equals_trying_every_alignment(spark, seed):
    rng = random.Random(seed)
    words = lambda n: [f"t{rng.randrange(60)}" for _ in range(n)]
    items = [(k, words(n)) for k, n in enumerate((3, 8, 11, 12, 15, 20, 27, 45))]
    docs = [(n, words(rng.randrange(10, 60))) for n in range(12)]
    for k, item in items:
        for wrong in range(6):
            text = list(item)
            for p in rng.sample(range(len(text)), min(wrong, len(text))):
                text[p] = f"z{rng.random()}"
            docs.append((100 * (k + 1) + wrong, words(7) + text + words(5)))
    docs, items = [(d, " ".join(t).upper()) for d, t in docs], [(i, ", ".join(t)) for i, t in items]
    make = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(make(docs, "doc_id"), make(items, "item_id"), block_bytes=200).collect()}
    assert got == plain_contamination(docs, items)
