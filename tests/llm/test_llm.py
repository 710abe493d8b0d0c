"""The llm operators: brute force on small tables, held-out accuracy, awkward rows, planted cases."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stie.llm import decontaminate, jaccard_join, kernels, language_id, line_dedup, mixing, quality, repeats, suffix, toxicity, topk
from stie.llm import queries as registry
from stie.llm.components import components
from stie.llm.substring_dedup import substring_dedup
from stie.llm.suffix_dedup import suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ["chunk", "bucket", "key", "row", "site", "host", "kept", "copy", "copies", "of", "rate", "target", "band", "doc", "cluster", "label", "block", "hash", "salt", "score", "held_out", "size", "n"]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls everywhere, empty and very long texts, repeated rows and ids, columns with clashing names."""
    rng = random.Random(5)
    long, copy = prose(rng, 40_000, 9000), prose(rng, 120)
    rows = [(1, copy, "en", "a", 1), (1, copy, "en", "a", 1), (2, copy, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, long, "de", "b", 9), (6, long, "de", "b", 9), (None, copy, "fr", None, 1), (None, None, None, None, None), (7, " \t\n ", "en", "a", 4), (8, "é" * 200, "fr", "c", 200), (9, "a b", "en", "c", 3), (1, "other text under one id " * 20, "en", "c", 1), (10, "\x00\x01 " * 40, "en", "c", 80)]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASHING:
        df = df.withColumn(c, F.lit(f"extra {c}"))
    return df


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


# suffix arrays and repeats


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=14).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=4), min_size=1, max_size=4), st.booleans())
def test_suffix_arrays(groups, together):
    texts = [b"\0" + b"\0".join(parts) + b"\0" for parts in groups] * (40 if together else 1)
    first = np.cumsum([0] + [len(t) for t in texts])
    got = suffix.suffix_arrays(np.frombuffer(b"".join(texts), np.uint8).astype(np.int64), first)
    for t, text in enumerate(texts):
        order = (got[first[t] : first[t + 1]] - first[t]).tolist()
        assert sorted(order) == list(range(len(text)))
        keys = [text[i:].split(b"\0")[0] for i in order]
        assert keys == sorted(keys)


def expected_removal(docs, unit, window):
    first = {}
    for d, t in docs:
        for _, w in repeats.windows_of(t, unit, window):
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, t in docs:
        symbols = (t or "").encode() if unit == "byte" else (t or "").encode().split()
        gone = [False] * len(symbols)
        for i, w in repeats.windows_of(t, unit, window):
            if first[w] < d:
                gone[i : i + window] = [True] * window
        kept = [s for s, g in zip(symbols, gone, strict=True) if not g]
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(symbols), sum(gone), spans, hashlib.sha256(bytes(kept) if unit == "byte" else b" ".join(kept)).hexdigest())
    return out


def corpus(seed):
    """Copies, near copies, shared passages, periodic texts and a line that all hold."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 260)) for _ in range(25)]
    docs = list(base)
    for b in base[:12]:
        words = b.split()
        for _ in range(3):
            words[rng.randrange(len(words))] = "changed"
        docs += [b, " ".join(words), prose(rng, 20) + " " + b + "  " + prose(rng, 30)]
    line = prose(rng, 60)
    docs += [f"{prose(rng, 15)}\n{line}\n{prose(rng, 15)}" for _ in range(20)] + ["ab ab " * 150, "ab ab " * 90, "x" * 500, "x" * 120, "", None]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("unit", "operator", "hot"), [("word", substring_dedup, 2048), ("byte", suffix_dedup, 2048), ("word", substring_dedup, 4), ("byte", suffix_dedup, 4)])
def test_repeats_equal_brute_force(spark, unit, operator, hot):
    texts = corpus(11)
    got = operator(frame(spark, texts), hot=hot, chunk_bytes=2000).collect()
    expected = expected_removal(list(enumerate(texts)), unit, 50)
    assert {r.doc_id: (r["n_words" if unit == "word" else "n_bytes"], r.n_removed, r.n_spans, r.kept_sha256) for r in got} == expected
    assert sum(e[1] for e in expected.values()) > 1000


@pytest.mark.parametrize(("unit", "operator"), [("word", substring_dedup), ("byte", suffix_dedup)])
def test_repeats_on_awkward_rows(awkward, empty, unit, operator):
    rows = operator(awkward, texts=True).collect()
    assert len(rows) == awkward.count()
    count = "n_words" if unit == "word" else "n_bytes"
    assert all(r.n_removed == 0 for r in rows if r.doc_id in (None, 1, 3, 4, 7))
    assert [r.n_removed == r[count] > 0 for r in rows if r.doc_id in (2, 6)] == [True, True]
    assert operator(empty).collect() == []


# classifiers


def insulting(rng, n):
    rows = []
    for i in range(n):
        words = [f"word{rng.randrange(300)}" for _ in range(60)]
        kind = i % 4
        if kind == 0:  # only together are these two toxic
            words[5], words[30] = "grumble", "folks"
        elif kind == 1:
            words[7] = "grumble"
        elif kind == 2:
            words[9] = "folks"
        rows.append((i, " ".join(words), int(kind == 0)))
    return rows


def test_interactions_are_learned(spark):
    rows = insulting(random.Random(1), 1200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, least=20)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 100 and sum(p == y for p, y in held) / len(held) > 0.97


def test_toxicity_on_the_tables(spark, sf):
    import duckdb

    got = {r.doc_id: r for r in registry.QUERIES["op2_toxicity"](spark, sf).collect()}
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert np.mean([got[d].predicted == y for d, y in labels]) > 0.9


def test_language_accuracy(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = registry.QUERIES["op3_language_id"](spark, sf).collect()
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert np.mean(held) > 0.95


def test_grades_are_ordered(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("good", "fine", "nice")) if rng.random() < g / 4 else rng.choice(("%%%", "###")) for _ in range(80)), g) for i in range(600) for g in [i % 5]]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality.fit_quality(docs, spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, quality int"))
    assert (np.diff(model.thresholds) > 0).all() and model.grades == [0, 1, 2, 3, 4]
    got = {r.doc_id: r for r in quality.quality(docs, model, select=3).collect()}
    held = [(got[i].expected_grade, g) for i, _, g in rows if got[i].held_out]
    assert np.mean([abs(e - g) for e, g in held]) < 0.6
    assert np.mean([got[i].selected == (g >= 3) for i, _, g in rows]) > 0.85


def test_models_on_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 11)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    for docs, marks in ((awkward, labels), (awkward, labels.where("false")), (empty, labels)):
        tox = toxicity.toxicity(docs, toxicity.fit_toxicity(docs, marks)).collect()
        lang = language_id.identify_languages(docs, language_id.fit_languages(docs)).collect()
        grade = quality.quality(docs, quality.fit_quality(docs, marks)).collect()
        n = docs.count()
        assert len(tox) == len(lang) == len(grade) == n
        assert all(0 <= r.score <= 1 for r in [*tox, *lang]) and all(r.held_out for r in tox if r.doc_id is None)
        assert all(r.lang_pred == "und" for r in lang if r.doc_id in (3, 4, 7))
    assert toxicity.without_toxic(awkward, toxicity.fit_toxicity(awkward, labels.where("false"))).count() == awkward.count()


def test_labels_of_the_held_out_fold_are_not_used(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit_toxicity(docs, x) for x in (labels, flipped))
    assert a.cut == b.cut and (a.machine.weights == b.machine.weights).all()


# decontamination


def test_planted_items_are_found(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randint(12, 60), 3000)) for i in range(30)]
    docs, planted = [], set()
    for d in range(120):
        words = prose(rng, 150, 3000).split()
        if d % 3 == 0:
            i, text = rng.choice(items)
            part = text.split()
            for k in range(0, len(part), 10):  # a substitution in ten
                if d % 2:
                    part[k] = "substituted"
            at = rng.randrange(len(words))
            words[at:at] = (" ".join(part).upper().replace(".", " ,") if d % 4 == 0 else " ".join(part)).split()
            planted.add((d, i))
        docs.append((d, " ".join(words)))
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=2000).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found <= planted and len(found) >= 0.97 * len(planted)
    clean = decontaminate.without_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id for r in clean} == {d for d, _ in docs} - {d for d, _ in found}


def test_decontamination_on_awkward_rows(spark, awkward, empty):
    copy = awkward.where("doc_id = 2").first().text
    items = spark.createDataFrame([(1, copy), (1, copy), (None, copy), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    got = decontaminate.decontaminate(awkward, items).collect()
    assert {r.doc_id for r in got} == {1, 2, None} and {r.item_id for r in got} == {1, None}
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(awkward, items.where("false")).count() == 0
    assert decontaminate.without_contaminated(awkward, items.where("false")).count() == awkward.count()


# lines and mixing


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_lines_of_a_site(spark, broadcast):
    rows = [(i, f"{'menu' if i % 2 else 'home'}\nbody {i}\n\nfooter", "a", i) for i in range(30)] + [(100 + i, f"footer\nbody {i}", f"lonely{i}", 0) for i in range(5)] + [(200, None, "a", 0), (201, "footer", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, site int")
    got = {r.doc_id: (r.n_lines, r.n_dropped, list(r.kept)) for r in line_dedup.line_dedup(docs, F.col("source"), line_dedup.text_lines(F.col("text")), 0.4, broadcast_lines=broadcast).collect()}
    assert got[3] == (4, 2, ["body 3", ""]) and got[100] == (2, 0, ["footer", "body 0"]) and got[200] == (0, 0, []) and got[201] == (1, 0, ["footer"])


def test_lines_and_mix_on_awkward_rows(awkward, empty):
    for docs in (awkward, empty):
        n = docs.count()
        assert line_dedup.line_dedup(docs, F.col("source"), line_dedup.text_lines(F.col("text"))).count() == n
        assert mixing.mix(docs).count() == n
        mixed = mixing.mixed_documents(docs)
        assert set(mixed.columns) == set(docs.columns) and mixed.where("size <> 'extra size'").count() == 0


def test_targets_are_water_filled(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500), (None, 300), ("e", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["b"] == 30 and got["e"] == 0 and sum(got.values()) == pytest.approx(1810)
    assert got["c"] / got["a"] == pytest.approx(3) and got[None] / got["a"] == pytest.approx(2)


def test_mix_is_stable_and_close(spark, sf):
    a, b = (sorted(map(tuple, registry.QUERIES["op8_mix"](spark, sf).collect())) for _ in range(2))
    assert a == b and all(taken <= 3 * size for _, size, _, _, taken, _ in a)
    docs = frame(spark, [prose(random.Random(i), 40) for i in range(3000)])
    mixed = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t / r.g - 1) < 0.1 for r in mixed)
    copies = mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert mixing.mixed_documents(docs).count() == copies


def test_rows_without_an_id_or_with_a_shared_one_are_drawn_apart(spark):
    text = "ten words that are the same in all of them"
    rows = [(None, text, "a")] * 400 + [(7, text, "b")] * 400 + [(i, text, "c") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mixing.mix(docs)
    for r in found.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("g"), F.count("*").alias("n")).collect():
        assert r.n == 400 and abs(r.t / r.g - 1) < 0.1, r
    count = lambda d: sorted((str(r.doc_id), r.source, r["count"]) for r in d.groupBy("doc_id", "source").count().collect())
    assert count(mixing.mixed_documents(docs)) == count(mixing.mixed_documents(docs.repartition(3)))
    assert mixing.mixed_documents(docs).count() == found.agg(F.sum("copies")).first()[0]


# search


def brute_top(rows, k=5):
    out = []
    for i, q in rows:
        if i % 50 == 0:
            best = sorted(((-int(np.dot(q.astype(object), v.astype(object))), j) for j, v in rows if j != i))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("part", [50, 8192])
def test_top_k_is_exact(spark, part):
    rng = np.random.default_rng(8)
    vectors = np.vstack([rng.normal(size=(260, 8)), np.repeat(rng.normal(size=(1, 8)), 90, axis=0), rng.normal(size=(50, 8)) * 20])
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vectors.astype(np.float32))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, part=part, block=3).collect())
    assert got == brute_top([(i, np.floor(256 * np.array(v))) for i, v in data])


def test_top_k_on_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [2.0, 1.0]), (50, [1.0]), (None, [1.0, 1.0]), (6, []), (100, [1e6, 1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit(1))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 100), (0, 2, 5), (100, 1, 0), (100, 2, 5)] or got == [(0, 1, 100), (0, 2, 5), (100, 1, 5), (100, 2, 0)]
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


# near duplicates


def brute_links(docs, t=0.8, k=5):
    sets = {}
    for d, text in docs:
        w = (text or "").encode().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    links, root = defaultdict(set), {d: d for d in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9:
                links[a].add(b)
                links[b].add(a)
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (find(d), len(links[d])) for d in sets}


@pytest.mark.parametrize(("crowd", "block"), [(512, 256), (3, 6)])
def test_jaccard_join_equals_brute_force(spark, crowd, block):
    rng = random.Random(9)
    docs = [prose(rng, rng.randint(1, 120), 5000) for _ in range(60)]
    for b in list(docs[:15]):
        words = b.split()
        for n in range(9):  # near and farther
            changed = list(words)
            for _ in range(n // 2):
                changed[rng.randrange(len(changed))] = f"new{rng.random()}"
            docs.append(" ".join(changed))
    rng.shuffle(docs)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(frame(spark, docs), crowd=crowd, block=block).collect()}
    assert got == brute_links(list(enumerate(docs)))


def test_jaccard_join_on_awkward_rows(awkward, empty):
    rows = jaccard_join.jaccard_join(awkward).collect()
    assert len(rows) == awkward.count()
    assert {(r.doc_id, r.class_id) for r in rows if r.doc_id in (2, 3, 4, 5, 6, 9)} == {(2, 1), (3, 3), (4, 4), (5, 5), (6, 5), (9, 9)}
    assert all(r.class_id is None and r.n_links == 0 for r in rows if r.doc_id is None)
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    for n, m in jaccard_join.least_matches(0.8, 1e-9):
        from math import comb

        lost = sum(comb(n, i) * 0.8**i * 0.2 ** (n - i) for i in range(m))
        assert lost < 1e-7 and m > n * 0.15


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {i: 0 for i in range(1, 301)} | {901: 900}


def test_words_are_the_contracts_words():
    texts = ["a b c\x0bd\x1ce", "", None, "  ", "é ü\tß"]
    buf, offsets = kernels.text_buffer(pa.array(texts))
    start, end, doc = kernels.word_spans(buf, offsets)
    words = [(int(d), buf[s:e].tobytes().decode()) for s, e, d in zip(start, end, doc, strict=True)]
    assert words == [(0, "a b"), (0, "c"), (0, "d\x1ce"), (4, "é"), (4, "ü"), (4, "ß")]
