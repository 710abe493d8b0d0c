"""Operator 11 against a plain tree in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from stie.llm import common, merkle

H = lambda text: hashlib.sha256(text.encode()).hexdigest()
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, at long"


def leaf(values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """All levels from the nodes to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def path(levels, at):
    for level in levels[:-1]:
        first = at - at % 8
        yield "".join(level[first:at]), "".join(level[at + 1 : first + 8])
        at //= 8


def plain(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row[:5]), row))
    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    levels = {k: climb([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in keys}
    top = climb([levels[k][-1][0] for k in keys])
    for t, k in enumerate(keys):
        for i, (_, _, hash_, row) in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            proof = [*path(levels[k], i), *path(top, t)]
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf([*row[:4], text])
            for left, right in proof:
                node = H(left + node + right)
            yield row[0], hash_, levels[k][-1][0], top[-1][0], H("".join(a + b for a, b in proof)), node, node == top[-1][0]


def checked(spark, rows, every=3):
    df = spark.createDataFrame([(*r, "own", 5) for r in rows], SCHEMA)
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.manifest(df, F.col("lang"), "doc_id", merkle.COLUMNS, F.when(picked, F.translate("text", merkle.UPPER, merkle.LOWER)), every)
    proof = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    again = merkle.folded(F.coalesce("changed", "leaf"), F.col("proof"))
    return [tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", merkle.digest(proof), again, again == F.col("root")).collect()]


ROWS = [
    *((i, f"s{i % 3}", "en", i, f"Text No {i}") for i in range(700)),  # more than one stored subtree
    *((i, None, "fr", None, f"É{i}") for i in range(9)),
    (3, "a", "de", 1, "A"), (3, "a", "de", 1, "A"), (3, "b", "de", 1, None), (None, None, "de", 2, ""), (None, None, "de", 2, "Aa"),
    (5, "x", "one", 4, "Lone leaf"), (6, "x", None, 4, "LONG " * 50_000), (7, None, None, None, None), (8, "", "", 0, ""),
]


@pytest.mark.parametrize("every", [1, 2, 3])
def test_same_rows_as_a_plain_tree(spark, every):
    key = lambda r: tuple(str(x) for x in r)
    got, expected = sorted(checked(spark, ROWS, every), key=key), sorted(plain(ROWS), key=key)
    assert got == expected
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_small_and_empty_tables(spark):
    assert checked(spark, []) == []
    only = [(1, "a", "en", 1, "x")]
    assert checked(spark, only) == list(plain(only))


def test_roots_meet_the_leaves_in_a_shuffle_too(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    key = lambda r: tuple(str(x) for x in r)
    rows = ROWS[-30:]
    assert sorted(checked(spark, rows, 1), key=key) == sorted(plain(rows), key=key)
