"""Operator 13: the filters' round trip, and phrases against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stie.llm.collocations import phrases
from stie.llm.quotient import Packing, entries_of, filters, merged, summed

U64 = np.uint64


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 8), st.integers(1, 23), st.integers(1, 5), st.integers(0, 6), st.integers(0, 10_000))
def test_filters_give_every_phrase_and_count_back(group_bits, word_bits, size, shard_bits, seed):
    rng = np.random.default_rng(seed)
    packing = Packing(group_bits, word_bits, size)
    shard_bits, n = min(shard_bits, packing.half), 300
    group, words = rng.integers(0, 1 << group_bits, n), [rng.integers(0, 1 << min(word_bits, 3 + seed % 20), n) for _ in range(size)]
    left, right = packing.keys(group, words)
    again = packing.words(left, right)
    assert again[0].tolist() == group.tolist() and [w.tolist() for w in again[1]] == [w.tolist() for w in words]

    counts = Counter(zip(left.tolist(), right.tolist(), strict=True))
    big = {k: v + 255 * (i % 3) + (1 << 40) * (i == 5) for i, (k, v) in enumerate(counts.items())}
    a, b, c = (np.array(x) for x in zip(*((*k, v) for k, v in big.items()), strict=True))
    entries = summed(a.astype(U64), b.astype(U64), c, packing.half)
    found = Counter()
    for row in filters(entries, packing, shard_bits).to_pylist():
        both = merged([row, row], packing, shard_bits)
        one = entries_of(row, packing, shard_bits)
        assert [x.tolist() for x in both[:2]] == [x.tolist() for x in one[:2]] and both[2].tolist() == (2 * one[2]).tolist()
        found.update(dict(zip(zip(one[0].tolist(), one[1].tolist(), strict=True), one[2].tolist(), strict=True)))
    assert found == big


def plain(rows, least, absorbed=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = tuple(w for w in re.split("[ \t]+", piece) if w)
            n[lang] += len(words)
            f.update((lang, words[i : i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    often = {k: v for k, v in f.items() if v >= least and len(k[1]) >= 2}
    longer = {}
    for (lang, p), v in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i : i + m]] = max(v, longer.get((lang, p[i : i + m]), 0))
    for (lang, p), a in often.items():
        if 100 * longer.get((lang, p), -1) < absorbed * a:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            yield lang, " ".join(p), len(p), a, l, r, n[lang], score


def texts():
    rng = random.Random(5)
    words = ["New", "york", "city", "été", "of", "the", "a\x1cb", "x" * 300, *(f"w{i}" for i in range(40))]
    rows = [(" ".join(rng.choices(words, weights=[9] * 6 + [1] * (len(words) - 6), k=rng.randrange(60))).replace(" w1 ", ". ").replace(" w2 ", "\n\t"), rng.choice(["en", "en", "fr", None, "und", ""])) for _ in range(250)]
    return [*rows, *[("the the the the the the, of THE", "en")] * 20, (None, "en"), ("", None), (" . ,", "fr"), ("new york " * 20_000, "fr")]


def found(spark, rows, **more):
    df = spark.createDataFrame([(t, l, 1, "x") for t, l in rows], "text string, lang string, ids int, word string")
    return sorted(tuple(r) for r in phrases(df, F.col("lang"), **more).select("lang", "phrase", "words", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("more", [{}, {"slots": 50, "sieve_bits": 5}, {"most_words": 0, "absorbed": 60}, {"widest": 20}])
def test_same_phrases_as_plain_counting(spark, more):
    rows = texts()
    expected = sorted(plain(rows, 12, more.get("absorbed", 100)))
    assert len(expected) > 50
    assert found(spark, rows, least=12, **more) == expected


def test_no_text_no_phrases(spark):
    assert found(spark, [], least=2) == [] and found(spark, [(None, None), ("", "en"), ("one two", "en")], least=2) == []
