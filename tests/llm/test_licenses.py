"""Operator 12 against plain scans, and what the diagonals make of changed notices."""

import re

import pytest

from stie.llm import licenses
from stie.llm.licenses import NOTICES, PHRASES, Template, license_scan

SCHEMA = "doc_id long, text string, key string, words string"


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def plain(text, phrases, notices, gram=4, slack=8, least=0.75):
    words = words_of(text)
    places, labels, base, score = [], set(), set(), 0.0
    for t in phrases:
        own = t.words
        at = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
        k = min(gram, len(own))
        for d in {p - q for q in range(len(own) - k + 1) for p in range(len(words) - k + 1) if words[p : p + k] == own[q : q + k]}:
            score = max(score, sum(any(words[d + q : d + q + k] == own[q : q + k] and d + q >= 0 for q in range(max(0, w - k + 1), min(w, len(own) - k) + 1)) for w in range(len(own))) / len(own))
        places += at
        if at:
            base.add(t.label)
    for t in notices:
        own = t.words
        k = min(gram, len(own))
        diagonals = {}
        for p in range(len(words) - k + 1):
            for q in range(len(own) - k + 1):
                if words[p : p + k] == own[q : q + k]:
                    diagonals.setdefault(p - q, set()).update(range(q, q + k))
        for d in diagonals:
            share = len(set().union(*(v for e, v in diagonals.items() if abs(e - d) <= slack))) / len(own)
            score = max(score, share)
            if share >= least:
                labels.add(t.label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def scanned(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "k", "w") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in license_scan(df, **more).collect()), key=str)


MIT = NOTICES[9].text
CASES = [
    (1, "Under the MIT License, or the Apache-License; MIT license! cc-by CC BY 4.0"), (2, None), (3, ""), (None, "mit"), (None, None), (4, "GNU General Public"), (5, "mit license"), (5, "mit license"), (5, "no"),
    (6, MIT), (7, MIT.replace("free of charge", "wholly free of any charge or fee")), (8, MIT[:60]), (9, "é mit license ümit license"), (10, "gnu " * 50 + "general public license apache license apache license"),
    (11, "word " * 9_000 + "mit license " + "w " * 4_085 + NOTICES[0].text), (12, "x " * 4_095 + "mit license"), (13, "x " * 4_094 + "gnu general public license gpl"), (14, NOTICES[5].text + " " + NOTICES[8].text),
    (15, "A\x00mit\x7flicense 'cc' by"), (16, "Licensed under CC BY-NC 4.0."), (17, "cc  by by cc by"),
]


def test_same_rows_as_a_plain_scan(spark):
    expected = sorted(((i, *plain(t, PHRASES, NOTICES)) for i, t in CASES), key=str)
    assert scanned(spark, CASES) == expected


@pytest.mark.parametrize("gram", [2, 3])
def test_other_runs_and_longer_phrases(spark, gram, monkeypatch):
    monkeypatch.setattr(licenses, "SEGMENT", 7)
    phrases, notices = (Template("long", "one two three four five six", phrase=True), *PHRASES), (Template("n", "a b c d e f g h i j"), Template("m", "a b a b a b"))
    rows = [(1, "one two three four five six one two three four five"), (2, "one two three four one two three four five six six"), (3, "a b c d x e f g h i j"), (4, "a b c x x x x x x x x x x d e f g"), (5, "a b " * 9), (6, "f g h i j a b c d e")]
    expected = sorted(((i, *plain(t, phrases, notices, gram)) for i, t in rows), key=str)
    assert scanned(spark, rows, phrases=phrases, notices=notices, gram=gram) == expected


def test_changed_notices_keep_their_label(spark):
    found = {r[0]: r for r in scanned(spark, CASES)}
    assert found[6][6] == found[7][6] == "mit" and found[6][7] == 1.0 and 0.75 <= found[7][7] < 1.0
    assert found[8][6] == "" and found[16][5:7] == ("cc-by", "cc-by,cc-by-nc")
    assert scanned(spark, []) == []
