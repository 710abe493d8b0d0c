"""Array kernels that the text operators run inside Spark tasks.

All of them work on a batch of documents at once: one byte buffer plus offsets, as Arrow
lays strings out. Words are what the contracts call words: `[^\\x20\\x09-\\x0D]+`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD6E8FEB86659FD93)
_BASE_INV = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_ODD = U64(0xC2B2AE3D27D4EB4F)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)
_POWERS: dict[str, np.ndarray] = {}

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: equal in, equal out, and well spread."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTES = mix(np.arange(1, 257, dtype=U64) * _GOLD)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=U64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which range_hash() takes the hash of any run of values."""
    up, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end], the same wherever the run stands."""
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * _GOLD)


def run_hash(sums: np.ndarray, size: int) -> np.ndarray:
    """range_hash() of every run of `size` values."""
    if len(sums) <= size:
        return np.zeros(0, dtype=U64)
    _, down = _powers(len(sums))
    return mix((sums[size:] - sums[:-size]) * down[: len(sums) - size] + np.full(1, size, dtype=U64) * _GOLD)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    if len(values) < width:
        return values[:0]
    cur, span, n = values, 1, len(values) - width + 1
    while span * 2 <= width:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    return np.minimum(cur[:n], cur[width - span : width - span + n])


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_string()).combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents with about `limit` bytes each; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = j


def word_spans(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word."""
    if not len(buf):
        return (np.zeros(0, dtype=np.int64),) * 3
    inside = ~separators[buf]
    edge = offsets[:-1][np.diff(offsets) > 0]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[edge] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edge[1:] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, from its bytes eight at a time.

    Each piece of eight is mixed with its place in the word before the pieces are added, so there is no
    structure (as in a polynomial) by which long words of few symbols could collide.
    """
    size = end - start
    if not len(size):
        return np.zeros(0, dtype=U64)
    padded = np.append(buf, np.zeros(8, dtype=np.uint8))
    eights = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    first = _eight(eights[start], size)
    out = mix(first * _ODD + size.astype(U64))
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        place = spans_of(np.ones(len(long), dtype=np.int64), more)
        at = np.repeat(start[long], more) + place * 8
        left = np.repeat(end[long], more) - at
        pieces = mix(mix(_eight(eights[at], left) + _GOLD) ^ mix(place.astype(U64) * _ODD))
        out[long] = mix(out[long] + np.add.reduceat(pieces, np.cumsum(more) - more))
    return out


def _eight(values: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes, of which those from `left` on don't count."""
    return values & _MASKS[np.minimum(left, 8)]


def word_numbers(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of the words: two words have one number if, and only if, their bytes are equal."""
    size = end - start
    data = pa.py_buffer(np.ascontiguousarray(buf[spans_of(start, size)]))
    offsets = pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64))
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, offsets, data])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def spans_of(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of first[i] .. first[i] + size[i] - 1, one after the other."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(size)
    return np.arange(total) + np.repeat(first - ends + size, size)


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of every run of equal keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, n))
