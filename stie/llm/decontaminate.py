"""Operator 5, benchmark decontamination by spaced seeds.

A pair is reported if somewhere `overlap` tokens in a row (the whole item, if it is shorter) agree
in at least `identity` of the positions. A seed is a fixed mask: some positions are hashed, those between
are ignored. For every length of window, the mask is the heaviest spaced one that is lossless: whatever
positions differ, as far as `identity` allows, the mask still fits somewhere between them (`spaced_mask` tries
every pattern; for 20 tokens with 16 of them equal it hashes 1, 2, 3 and 5). The hashes of the
benchmark are joined with those of the documents; around every hit, the document and the item are laid on
each other on the hit's diagonal and compared token by token.

Tokens are lower-case runs of letters and digits, so case, spacing and punctuation don't
count; a token put in or left out ends a diagonal. Items of fewer than `shortest` tokens are found
as whole, exact token sequences only. The benchmark is the small side: it goes to the executors in
blocks of about `block_bytes`, one pass over the documents a block, so what is broadcast is bounded.
The documents are read where they lie; nothing of them is shuffled but the pairs that are found.

Null and empty texts hold nothing. Rows that repeat give the same pairs once each; a null
doc_id or item_id is reported as null. Long texts are read whole, in blocks. An empty table, on either side,
gives no pairs. Documents may have any other columns, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stie.llm import kernels as K
from stie.llm.common import table

U64 = np.uint64
FILTER_BITS = 22
CELLS = 1 << 20
MOST_PATTERNS = 20_000

SEPARATORS = np.ones(256, dtype=bool)
SEPARATORS[128:] = False
for _from, _to in (("0", "9"), ("A", "Z"), ("a", "z")):
    SEPARATORS[ord(_from) : ord(_to) + 1] = False


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of documents: first, last, token hashes and where each document's begin."""
    buf, offsets = K.text_buffer(pc.utf8_lower(column.cast(pa.large_string())))
    for i, j in K.blocks(offsets):
        part, bounds = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, doc = K.word_spans(part, bounds, SEPARATORS)
        yield i, j, K.word_hashes(part, start, end), np.searchsorted(doc, np.arange(j - i + 1))


def seeds(values: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of the tokens at the mask's positions, at every place where it fits."""
    n = len(values) - mask[-1]
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.full(n, hash(mask) & ((1 << 63) - 1), dtype=U64)
    for at in mask:
        out = (out ^ values[at : at + n]) * U64(0x9FB21C651E98DF25)
        out ^= out >> U64(29)
    return out


@lru_cache(maxsize=None)
def spaced_mask(window: int, equal: int) -> tuple[int, ...]:
    """The heaviest mask with ignored positions that fits somewhere whatever window - equal of the positions differ.

    A run of ceil(equal / (differences + 1)) equal tokens is always left, so that many positions in a row are
    lossless; spaced masks of one position more are tried first, then of as many. Where there are too many patterns to try
    them all, or no spaced mask is lossless, the run itself is the mask.
    """
    wrong = window - equal
    run = -(-equal // (wrong + 1))
    if not wrong or math.comb(window, wrong) > MOST_PATTERNS:
        return tuple(range(max(1, run)))
    patterns = [sum(1 << p for p in pattern) for pattern in itertools.combinations(range(window), wrong)]
    for weight in (run + 1, run):
        for span in range(weight + 1, min(window, weight + 4) + 1) if weight > 1 else ():
            for inner in itertools.combinations(range(1, span - 1), weight - 2):
                mask = (0, *inner, span - 1)
                places = [sum(1 << (p + at) for at in mask) for p in range(window - span + 1)]
                if all(any(not place & pattern for place in places) for pattern in patterns):
                    return mask
    return tuple(range(max(1, run)))


def demand(size: int, overlap: int, identity: float, shortest: int) -> tuple[int, int, tuple[int, ...]]:
    """Of an item of so many tokens: tokens in a row that are compared, how many must agree, and the mask of its seeds."""
    window = min(size, overlap)
    if size < shortest:
        return window, window, tuple(range(max(1, window)))
    equal = next(n for n in range(window + 1) if n >= identity * window)
    return window, equal, spaced_mask(window, equal)


@dataclass
class Block:
    """Some items of the benchmark: ids, tokens, what each demands, and their seeds in order."""

    ids: list[int | None]
    values: np.ndarray
    begins: np.ndarray
    demands: list[tuple[int, int, tuple[int, ...]]]
    masks: list[tuple[int, ...]]
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    filter: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]], overlap: int, identity: float, shortest: int) -> Block:
        parts = list(tokens(pa.array([t for _, t in rows], pa.string())))
        values = np.concatenate([x[2] for x in parts]) if parts else np.zeros(0, dtype=U64)
        sizes = np.concatenate([np.diff(x[3]) for x in parts]) if parts else np.zeros(0, dtype=np.int64)
        begins = np.append(0, np.cumsum(sizes))
        item = np.repeat(np.arange(len(sizes)), sizes)
        demands = [demand(int(n), overlap, identity, shortest) for n in sizes]
        masks = sorted({d[2] for d, n in zip(demands, sizes, strict=True) if n})
        own = np.array([masks.index(d[2]) if n else -1 for d, n in zip(demands, sizes, strict=True)], dtype=np.int64)
        found = [(np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64))]
        for k, mask in enumerate(masks):
            hashed = seeds(values, mask)
            here = np.arange(len(hashed))
            fits = (item[: len(hashed)] == item[mask[-1] :][: len(hashed)]) & (own[item[: len(hashed)]] == k)
            found.append((hashed[fits], here[fits]))
        hashes, at = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        order = np.argsort(hashes, kind="stable")
        hashes, at = hashes[order], at[order]
        flags = np.zeros(1 << FILTER_BITS, dtype=bool)
        flags[(hashes >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
        return cls([i for i, _ in rows], values, begins, demands, masks, hashes, item[at], at - begins[item[at]], flags)


def overlaps(values: np.ndarray, begins: np.ndarray, block: Block) -> list[tuple[int, int, int, int, int]]:
    """Document, item, first token in the document, tokens compared, tokens equal: the best stretch of every pair."""
    room = int(np.diff(block.begins).max(initial=0))
    width, many = len(values) + 2 * room + 1, len(begins)
    found = [np.zeros(0, dtype=np.int64)]
    doc_of = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    for mask in block.masks:
        hashed = seeds(values, mask)
        near = np.flatnonzero(block.filter[(hashed >> U64(64 - FILTER_BITS)).astype(np.int64)])
        near = near[doc_of[near] == doc_of[near + mask[-1]]]
        low, high = np.searchsorted(block.hashes, hashed[near], "left"), np.searchsorted(block.hashes, hashed[near], "right")
        hit = K.spans_of(low, high - low)
        where = np.repeat(near, high - low)
        found.append((block.item[hit] * many + doc_of[where]) * width + where - block.at[hit] + room)
    keys = np.unique(np.concatenate(found))
    owner, shifts = np.divmod(keys, width)
    items, docs = np.divmod(owner, many)
    shifts -= room
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for f, m in zip(*K.runs(items), strict=True):
        item = int(items[f])
        own = block.values[block.begins[item] : block.begins[item + 1]]
        window, least, _ = block.demands[item]
        step = max(1, CELLS // len(own))
        for p in range(f, f + m, step):
            doc, shift = docs[p : min(p + step, f + m)], shifts[p : min(p + step, f + m)]
            first, last = np.maximum(shift, begins[doc]), np.minimum(shift + len(own), begins[doc + 1])
            at = shift[:, None] + np.arange(len(own))
            equal = (values[np.clip(at, 0, len(values) - 1)] == own) & (at >= first[:, None]) & (at < last[:, None])
            sums = np.zeros((len(doc), len(own) + 1), dtype=np.int64)
            np.cumsum(equal, axis=1, out=sums[:, 1:])
            starts = at[:, : len(own) - window + 1]
            enough = (sums[:, window:] - sums[:, :-window] >= least) & (starts >= first[:, None]) & (starts + window <= last[:, None])
            for k in np.flatnonzero(enough.any(axis=1)):
                d, total = int(doc[k]), int(sums[k, -1])
                was = best.get((d, item))
                if was is None or was[2] < total:
                    best[d, item] = (int(first[k] - begins[d]), int(last[k] - first[k]), total)
    return [(int(d), int(i), *x) for (d, i), x in sorted(best.items())]


def decontaminate(documents: DataFrame, benchmark: DataFrame, overlap: int = 20, identity: float = 0.8, shortest: int = 11, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, item_id, first_token, n_tokens (compared), n_equal of every contaminated pair."""
    sent = documents.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, item_id long, first_token long, n_tokens long, n_equal long"

    def search(block: Block):
        def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out = []
                for i, _, values, begins in tokens(batch.column(1)):
                    out += [(ids[d + i], block.ids[item], first, n, equal) for d, item, first, n, equal in overlaps(values, begins, block)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "item_id", "first_token", "n_tokens", "n_equal"])

        return of_batches

    found = None
    for block in _blocks(benchmark, overlap, identity, shortest, block_bytes):
        part = sent.mapInArrow(search(block), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _blocks(benchmark: DataFrame, overlap: int, identity: float, shortest: int, block_bytes: int) -> Iterator[Block]:
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    count = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    for number in range(count):
        yield Block.of([(r.item_id, r.text) for r in items.where(F.col("block") == number).orderBy("item_id", "text").collect()], overlap, identity, shortest)


def without_contaminated(documents: DataFrame, benchmark: DataFrame, overlap: int = 20, identity: float = 0.8, shortest: int = 11, block_bytes: int = 4 << 20) -> DataFrame:
    """The documents that hold no item, with their columns; they are filtered where they lie."""
    schema, text = documents.schema, documents.columns.index("text")

    def keep(block: Block):
        def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for i, _, values, begins in tokens(batch.column(text)):
                    clean[[i + d for d, *_ in overlaps(values, begins, block)]] = False
                yield batch.filter(pa.array(clean))

        return of_batches

    for block in _blocks(benchmark, overlap, identity, shortest, block_bytes):
        documents = documents.mapInArrow(keep(block), schema)
    return documents


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
