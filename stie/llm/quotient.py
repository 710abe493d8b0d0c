"""Counting quotient filters over packed word-id n-grams.

An n-gram is packed into one number: a group (a language) and its word ids, all of fixed width. A Feistel
network permutes the numbers of that width; as it's invertible, no two n-grams ever share a key and every key
gives its n-gram back. The leading bits of a key name its shard, the next ones are its quotient, and all others
are kept as the remainder, so a counter is exact. A filter holds sorted keys: one bit for every
quotient tells whether it occurs, one bit for every slot whether its run of equal quotients ends there;
remainders take whole bytes, and counts a byte, those of 255 and more eight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from stie.llm.kernels import mix, runs

U64 = np.uint64
WIDEST = 126
_ROUNDS = [U64(k) for k in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


def mask(bits: int) -> np.uint64:
    return U64((1 << bits) - 1)


@dataclass(frozen=True)
class Packing:
    """How n-grams of `size` words, of ids below 2 ** word_bits and groups below 2 ** group_bits, become two halves of a key."""

    group_bits: int
    word_bits: int
    size: int

    @property
    def half(self) -> int:
        return max(1, (self.group_bits + self.size * self.word_bits + 1) // 2)

    def keys(self, group: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        high, low = np.zeros(len(group), dtype=U64), group.astype(U64)
        for ids in words:
            high = (high << U64(self.word_bits)) | (low >> U64(64 - self.word_bits))
            low = (low << U64(self.word_bits)) | ids.astype(U64)
        h = U64(self.half)
        left, right = ((high << (U64(64) - h)) | (low >> h)) & mask(self.half), low & mask(self.half)
        for k in _ROUNDS:
            left, right = right, left ^ (mix(right + k) & mask(self.half))
        return left, right

    def words(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Groups and ids again."""
        for k in reversed(_ROUNDS):
            left, right = right ^ (mix(left + k) & mask(self.half)), left
        h, b = U64(self.half), U64(self.word_bits)
        high, low = left >> (U64(64) - h), (left << h) | right
        out = []
        for _ in range(self.size):
            out.append(low & mask(self.word_bits))
            low = (low >> b) | (high << (U64(64) - b))
            high = high >> b
        return low, out[::-1]

    def leading(self, left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
        """The first `bits` of the keys, or all of a shorter key."""
        if bits <= self.half:
            return left >> U64(self.half - bits)
        if bits >= 2 * self.half:
            return (left << U64(self.half)) | right
        return (left << U64(bits - self.half)) | (right >> U64(2 * self.half - bits))


Entries = tuple[np.ndarray, np.ndarray, np.ndarray]  # left and right halves of sorted keys, and counts


def summed(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None, half: int) -> Entries:
    """Sorted distinct keys with the sums of their counts (of 1 each, without counts)."""
    if not len(left):
        return left, right, np.zeros(0, dtype=np.int64)
    if 2 * half <= 64:
        key = (left << U64(half)) | right
        if counts is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")  # merges runs that are sorted already
            key, counts = key[order], counts[order]
        first, n = runs(key)
        left, right = key[first] >> U64(half), key[first] & mask(half)
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        counts = None if counts is None else counts[order]
        first, n = runs(left, right)
        left, right = left[first], right[first]
    return left, right, n if counts is None else np.add.reduceat(counts, first)


def _as_bytes(values: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)]).tobytes()


def _from_bytes(data: bytes, bits: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    size = -(-bits // 8)
    if size:
        out[:, :size] = np.frombuffer(data, dtype=np.uint8).reshape(n, size)
    return out.view("<u8").ravel().astype(U64)


FILTERS = pa.schema([("shard", pa.int64()), ("slots", pa.int64()), ("quotient_bits", pa.int32()), *((n, pa.binary()) for n in ("occupied", "ends", "lefts", "rights", "counts", "more"))])
FILTER_COLUMNS = "shard long, slots long, quotient_bits int, occupied binary, ends binary, lefts binary, rights binary, counts binary, more binary"


def filters(entries: Entries, packing: Packing, shard_bits: int) -> pa.RecordBatch:
    """A filter for every shard that has keys. entries are sorted."""
    left, right, counts = entries
    rest = packing.half - shard_bits
    first, size = runs(left >> U64(rest))
    rows = []
    for a, n in zip(first.tolist(), size.tolist(), strict=True):
        l, r, c = left[a : a + n], right[a : a + n], counts[a : a + n]
        q = min(max(n.bit_length() - 1, 0), rest)
        quotient = (l >> U64(rest - q)) & mask(q)
        occupied, ends = np.zeros(1 << q, dtype=np.uint8), np.ones(n, dtype=np.uint8)
        occupied[quotient.astype(np.int64)] = 1
        ends[:-1] = quotient[1:] != quotient[:-1]
        rows.append((int(l[0] >> U64(rest)), n, q, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), _as_bytes(l & mask(rest - q), rest - q), _as_bytes(r, packing.half), np.minimum(c, 255).astype(np.uint8).tobytes(), c[c >= 255].astype("<i8").tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(FILTERS), FILTERS.types, strict=True)], schema=FILTERS)


def entries_of(row: dict, packing: Packing, shard_bits: int) -> Entries:
    """The keys and counts of a filter."""
    n, q, rest = row["slots"], row["quotient_bits"], packing.half - shard_bits
    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(row["occupied"], dtype=np.uint8), count=1 << q)).astype(U64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(row["ends"], dtype=np.uint8), count=n))
    quotient = np.repeat(occupied, np.diff(np.append(-1, ends)))
    left = (U64(row["shard"]) << U64(rest)) | (quotient << U64(rest - q)) | _from_bytes(row["lefts"], rest - q, n)
    counts = np.frombuffer(row["counts"], dtype=np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(row["more"], dtype="<i8")
    return left, _from_bytes(row["rights"], packing.half, n), counts


def merged(rows: list[dict], packing: Packing, shard_bits: int) -> Entries:
    """The filters of one shard as one."""
    parts = [entries_of(row, packing, shard_bits) for row in rows]
    return summed(*(np.concatenate(x) for x in zip(*parts, strict=True)), packing.half)
