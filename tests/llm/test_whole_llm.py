"""Corpus operators do the whole job, where they once left something out."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stie.llm import decontaminate, jaccard_join, line_dedup, repeats
from stie.llm.substring_dedup import substring_dedup
from stie.llm.suffix_dedup import suffix_dedup
from tests.llm.test_llm import expected_removal


def test_hosts_with_few_pages_are_judged(spark):
    rows = [(i, f"menu\nbody {i}", "two") for i in range(2)] + [(10 + i, f"menu\nbody {i}", "nine") for i in range(9)] + [(30, "menu\nbody", "one")] + [(40 + i, f"menu\nbody {i // 2}", "forty") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: list(r.kept) for r in line_dedup.line_dedup(docs, F.col("source"), line_dedup.text_lines(F.col("text"))).collect()}
    assert got[0] == ["body 0"] and got[18] == ["body 8"] and got[30] == ["menu", "body"] and got[40] == ["body 0"]


def words(letter, n=60):
    return " ".join(f"{letter}{i}" for i in range(n))


@pytest.mark.parametrize("turned", [False, True])
def test_a_near_copy_under_a_shared_id(spark, turned):
    """Whatever text's set comes first: B hangs on C, and A, of the same id, on nothing but its own copy."""
    a, c = (words("z"), words("q")) if turned else (words("q"), words("z"))
    b = c + " end"
    rows = [(2, c), (5, a), (5, b), (7, a + " tail"), (9, words("s")), (9, words("s") + " end"), (9, ""), (9, ""), (11, words("t")), (11, words("t").replace(" ", "  "))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.class_id, r.n_links, r.n_texts) for r in jaccard_join.jaccard_join(docs.select("doc_id", "text")).collect())
    assert got == [(2, 2, 1, 1), (5, 2, 1, 1), (5, 5, 1, 1), (7, 5, 1, 1), (9, 9, 0, 0), (9, 9, 0, 0), (9, 9, 1, 1), (9, 9, 1, 1), (11, 11, 1, 0), (11, 11, 1, 0)]
    left = [(r.doc_id, " ".join(r.text.split())) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    nines = [t for i, t in left if i == 9]
    assert sorted(x for x in left if x[0] != 9) == sorted([(2, c), (5, a), (11, words("t"))])
    assert len(nines) == 2 and "" in nines


@pytest.mark.parametrize("size, differ", [(11, 1), (11, 2), (12, 2), (15, 3), (20, 4)])
def test_every_pattern_that_identity_allows_is_found(size, differ):
    item = [f"w{i}" for i in range(size)]
    block = decontaminate.Block.of([(1, " ".join(item))], 20, 0.8, 11)
    patterns = list(itertools.combinations(range(size), differ))
    texts = [" ".join(["a", *("other" if i in p else w for i, w in enumerate(item)), "b"]) for p in patterns]
    found = sum(len(decontaminate.overlaps(values, begins, block)) for _, _, values, begins in decontaminate.tokens(pa.array(texts)))
    assert found == len(patterns)


def test_short_items_are_found_exactly(spark):
    items = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "name two of the five great lakes in order"), (3, "lonely")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so who wrote hamlet, then"), (2, "who wrote a hamlet"), (3, "name two of the five great lakes in turn"), (4, "Name two of the five great lakes in order"), (5, "hamlet"), (6, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_equal) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {(1, 1, 3), (4, 2, 9)}
    assert {r.doc_id for r in decontaminate.without_contaminated(docs, items).collect()} == {2, 3, 5, 6}


def thue_morse(n):
    text = b"a"
    while len(text) < n:
        text += text.translate(bytes.maketrans(b"ab", b"ba"))
    return text.decode(), text.translate(bytes.maketrans(b"ab", b"ba")).decode()


def test_words_that_a_polynomial_would_mix_up_stay_apart(spark):
    shared = " ".join(f"w{i}" for i in range(49))
    for size in (1024, 2048):
        one, other = thue_morse(size)
        docs = spark.createDataFrame([(0, f"{shared} {one}"), (1, f"{shared} {other}"), (2, f"{shared}\n{one} x")], "doc_id long, text string")
        assert {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()} == {0: 0, 1: 0, 2: 50}
        assert {r.n_texts for r in jaccard_join.jaccard_join(docs.where("doc_id < 2"), size=50).collect()} == {0}


@pytest.mark.parametrize("seed", range(3))
def test_seeds_that_very_many_contexts_share(spark, seed):
    """One phrase of 14 words in 150 documents, with every overlap on either side."""
    rng = random.Random(seed)
    phrase = [f"p{i}" for i in range(14)]
    left, right = [f"l{i}" for i in range(60)], [f"r{i}" for i in range(60)]
    texts = []
    for n in range(150):
        a, b = rng.randrange(0, 50), rng.randrange(0, 50)
        texts.append(" ".join([f"x{n}_{i}" for i in range(5)] + left[60 - a :] + phrase + right[:b] + [f"y{n}_{i}" for i in range(5)] + phrase))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = {d: e[1] for d, e in expected_removal(list(enumerate(texts)), "word", 50).items()}
    for hot in (2048, 8):
        assert {r.doc_id: r.n_removed for r in substring_dedup(docs, hot=hot, chunk_bytes=3000).collect()} == expected
    assert sum(expected.values()) > 1000


def test_all_removal_goes_through_extension_or_suffix_arrays(spark):
    """What the settling step gives back comes from `first_of` alone: where it finds nothing, nothing is removed."""
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(200))
    docs = spark.createDataFrame([(n, f"{base} tail{n}") for n in range(40)], "doc_id long, text string")
    blind = lambda buf, offsets, group, doc, count, **_: np.full(int(count.sum()), np.iinfo(np.int64).max)
    for unit, size, least, operator in (("word", 12, 200 * 39, substring_dedup), ("byte", 24, len(base) * 39, suffix_dedup)):
        one_each = {"chunk_bytes": 1200}
        found = repeats.remove_repeats(docs, unit, size, 50, blind, **one_each)
        inside = found.agg(F.sum("n_removed")).first()[0]  # copies that one chunk holds, compared byte by byte there
        assert operator(docs, **one_each).agg(F.sum("n_removed")).first()[0] >= least > inside
