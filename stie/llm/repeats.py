"""Removal of passages that also start in a document with a smaller id.

A window is `window` consecutive symbols (words or bytes) of one document. Every symbol
that is covered by a window whose content also starts in an earlier document goes; windows
are judged on the input. The work is split by anchors: the anchor of a window is the least
hash of its runs of `seed` symbols (winnowing), so equal windows have equal anchors, and
consecutive windows mostly share theirs. Consecutive windows with one anchor are a run, and
the symbols they cover are its context.

    chunks   documents dealt by id and text into pieces of about 8 MB of text
    seeds    chunk -> anchor bucket: the distinct anchors of the chunk, with counts
    shared   bucket -> chunk: which of them hold more than one context anywhere
    contexts chunk -> bucket: of shared anchors, the contexts that no earlier document of
             the chunk has; copies of a context that later documents of the chunk have are settled at once
    settle   bucket -> chunk: for every window of these contexts, the first document
    digest   chunk: the symbols left of every document

Hashes only bring together what may be equal. What is removed has been compared symbol by symbol:
copies of a context byte by byte, different contexts by the operator's own method (`first_of`).
Words are kept apart by one space each, so equal words mean equal bytes.

Texts are dealt once, and that exchange is read by three stages; anchors travel once, and contexts
only of shared anchors. No pairs travel: an anchor with n contexts costs n, and copies inside a chunk
cost nothing beyond it. A chunk sends at most one row to a bucket, and never more rows than
it has anchors, so the rows of an exchange are bounded by the anchors however many chunks there are.
An anchor with more than `hot` contexts (a line that very many documents hold) gets the longest seed
there is, the whole window: no group grows with the number of documents that share a
passage, as equal windows collapse in each chunk. The result is the same for any `hot`.

Documents without an id neither lose nor take anything, and are spread by their text. Rows with equal
ids don't take from each other. Null texts are empty. An empty table gives an empty result. Long texts
stand in one chunk whole, and are read in blocks. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stie.llm import kernels as K
from stie.llm.common import pieces
from stie.llm.suffix import suffix_arrays

U64 = np.uint64
HOT = 2048
FEW = 16  # seats that are extended each with each
LONGEST_RUN = 128
BATCH_BITS = 20  # symbols that are sorted together: many texts share each step, and few MB are at work
FIELDS = (("doc", np.int64), ("row", np.uint32), ("start", np.uint32), ("count", np.uint32))
ANCHOR_BYTES = 5  # of an anchor that travel; two anchors of a bucket that agree in these are compared as one


def _symbols(buf: np.ndarray, offsets: np.ndarray, unit: str):
    """Values of the symbols, where each document's begin, and the bytes that each takes."""
    if unit == "byte":
        at = np.arange(len(buf) + 1)
        return K.BYTES[buf], offsets, at[:-1], at[1:]
    start, end, doc = K.word_spans(buf, offsets)
    return K.word_hashes(buf, start, end), np.searchsorted(doc, np.arange(len(offsets))), start, end


def anchored_runs(buf: np.ndarray, offsets: np.ndarray, unit: str, seed: int, window: int) -> dict[str, np.ndarray]:
    """The runs of all documents: row, first window, windows, anchor, hash and bytes of the context."""
    found: list[tuple[np.ndarray, ...]] = []
    for i, j in K.blocks(offsets):
        part, bounds = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        values, begins, byte_from, byte_to = _symbols(part, bounds, unit)
        if len(values) < window:
            continue
        sums = K.prefix_sums(values)
        least = K.sliding_min(K.run_hash(sums, seed), window - seed + 1)
        doc = np.repeat(np.arange(j - i), np.diff(begins))[: len(least)]
        keep = np.flatnonzero(np.arange(len(least)) + window <= begins[1:][doc])
        least, doc = least[keep], doc[keep]
        first, count = K.runs(doc, least)
        parts = -(-count // LONGEST_RUN)
        nth = K.spans_of(np.zeros(len(first), dtype=np.int64), parts) * LONGEST_RUN
        count = np.minimum(np.repeat(count, parts) - nth, LONGEST_RUN)
        first = np.repeat(first, parts) + nth
        at, row = keep[first], doc[first]
        found.append((row + i, at - begins[row], count, K.mix(least[first]), K.range_hash(sums, at, at + count + window - 1), byte_from[at] + offsets[i], byte_to[at + count + window - 2] + offsets[i]))
    names = ("row", "start", "count", "anchor", "context", "from", "to")
    kinds = (np.int64, np.int64, np.int64, U64, U64, np.int64, np.int64)
    return {n: np.concatenate([x[k] for x in found]) if found else np.zeros(0, dtype=kinds[k]) for k, n in enumerate(names)}


def _one_space(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one space after each word in place of any separators."""
    gap = K.SPACES[buf]
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    keep[edge] = ~gap[edge]
    many = np.append(0, np.cumsum(keep, dtype=np.uint32)).astype(np.uint32)
    return np.where(gap, np.uint8(0x20), buf)[keep], many[offsets].astype(np.int64)


def _rows(chunk: pa.Table, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """The chunk in an order that every stage finds again; ids, and where there are none."""
    chunk = chunk.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = chunk.column("doc_id")
    none = ids.is_null().to_numpy()
    buf, offsets = K.text_buffer(chunk.column("text"))
    if unit == "word" and len(buf):
        buf, offsets = _one_space(buf, offsets)
    return buf, offsets, ids.fill_null(0).to_numpy().astype(np.int64), none, chunk


def _alike(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size[i] bytes from a[i] and from b[i] are the same."""
    out = np.ones(len(a), dtype=bool)
    for i, j in K.blocks(np.append(0, np.cumsum(size))):
        same = buf[K.spans_of(a[i:j], size[i:j])] == buf[K.spans_of(b[i:j], size[i:j])]
        out[i:j] = np.logical_and.reduceat(same, np.cumsum(size[i:j]) - size[i:j])
    return out


def _runs_of(chunk: pa.Table, unit: str, seed: int, window: int):
    buf, offsets, ids, none, _ = _rows(chunk, unit)
    found = anchored_runs(buf, offsets, unit, seed, window)
    if none.any():
        keep = ~none[found["row"]]
        found = {k: v[keep] for k, v in found.items()}
    order = np.lexsort((found["row"], found["context"], found["anchor"]))
    return buf, ids, {k: v[order] for k, v in found.items()}


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (((anchor >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


def _seeds(chunk: pa.Table, *, unit: str, seed: int, window: int, buckets: int) -> pa.Table:
    _, _, found = _runs_of(chunk, unit, seed, window)
    first, _ = K.runs(found["anchor"], found["context"])
    anchor = found["anchor"][first]
    first, contexts = K.runs(anchor)
    anchor = anchor[first]
    record = np.empty((len(anchor), 7), dtype=np.uint8)
    record[:, :5] = anchor.view(np.uint8).reshape(-1, 8)[:, :5]
    record[:, 5:] = np.minimum(contexts, 65535).astype(np.uint16).view(np.uint8).reshape(-1, 2)
    bucket = _bucket(anchor, buckets)
    start, many = K.runs(bucket)
    return pa.table({
        "bucket": pa.array(bucket[start], pa.int64()),
        "chunk": pa.array(np.full(len(start), chunk.column("chunk")[0].as_py()), pa.int64()),
        "payload": pa.array([record[s : s + m].tobytes() for s, m in zip(start, many, strict=True)], pa.binary()),
    })


def _shared(seeds: pa.Table, *, hot: int) -> pa.Table:
    blobs = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 7) for x in seeds.column("payload")]
    record = np.concatenate(blobs)
    key = np.zeros((len(record), 8), dtype=np.uint8)
    key[:, :5] = record[:, :5]
    key = key.view(U64).ravel()
    count = np.ascontiguousarray(record[:, 5:]).view(np.uint16).ravel().astype(np.int64)
    order = np.argsort(key, kind="stable")
    first, many = K.runs(key[order])
    total = np.add.reduceat(count[order], first)
    flag = np.empty(len(key), dtype=np.uint8)
    flag[order] = np.repeat((total > 1).astype(np.uint8) + (total > hot), many)
    ends = np.cumsum([len(x) for x in blobs])
    return pa.table({"chunk": seeds.column("chunk"), "bucket": seeds.column("bucket"), "flags": pa.array([flag[e - len(x) : e].tobytes() for e, x in zip(ends, blobs, strict=True)], pa.binary())})


def _short(anchor: np.ndarray) -> np.ndarray:
    return anchor.view(np.uint8).reshape(-1, 8)[:, :ANCHOR_BYTES]


def _pack(entries: dict[str, np.ndarray], chosen: slice, buf: np.ndarray) -> tuple[int, int, bytes]:
    part = {k: v[chosen] for k, v in entries.items()}
    size = part["to"] - part["from"]
    content = buf[K.spans_of(part["from"], size)]
    raw = b"".join([part[k].astype(kind).tobytes() for k, kind in FIELDS] + [(size - part["count"]).astype(np.uint32).tobytes(), np.ascontiguousarray(_short(part["anchor"]).T).tobytes(), content.tobytes()])
    return len(part["row"]), len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(count: int, raw: int, payload: pa.Buffer) -> tuple[dict[str, np.ndarray], np.ndarray]:
    data, at, out = pa.decompress(payload, decompressed_size=raw, codec="zstd"), 0, {}
    for name, kind in FIELDS:
        out[name] = np.frombuffer(data, kind, count, at).astype(np.int64)
        at += count * np.dtype(kind).itemsize
    out["size"] = out["count"] + np.frombuffer(data, np.uint32, count, at).astype(np.int64)
    at += 4 * count
    anchor = np.zeros((count, 8), dtype=np.uint8)
    anchor[:, :ANCHOR_BYTES] = np.frombuffer(data, np.uint8, ANCHOR_BYTES * count, at).reshape(ANCHOR_BYTES, count).T
    out["anchor"] = anchor.view(U64).ravel()
    return out, np.frombuffer(data, np.uint8, offset=at + ANCHOR_BYTES * count)


def _windows_apart(burst: dict[str, np.ndarray], buf: np.ndarray, unit: str, window: int) -> dict[str, np.ndarray]:
    """Every window of these contexts as a context of its own, with the whole window as its seed."""
    size = burst["to"] - burst["from"]
    begins = np.append(0, np.cumsum(size))
    single = anchored_runs(buf[K.spans_of(burst["from"], size)], begins, unit, window, window)
    of = single["row"]
    shift = burst["from"][of] - begins[of]
    return single | {"start": burst["start"][of] + single["start"], "row": burst["row"][of], "from": single["from"] + shift, "to": single["to"] + shift, "anchor": K.mix(~single["anchor"]), "flag": np.ones(len(of), np.uint8)}


MESSAGE = "bucket long, chunk long, kind int, n long, raw long, payload binary"


def _contexts(key: tuple, chunk: pa.Table, flags: pa.Table, *, unit: str, seed: int, window: int, buckets: int) -> pa.Table:
    out: dict[str, list] = {n: [] for n in ("bucket", "chunk", "kind", "n", "raw", "payload")}
    kinds = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("raw", pa.int64()), ("payload", pa.binary())])

    def put(bucket: int, kind: int, n: int, raw: int, payload: bytes) -> None:
        for name, value in zip(out, (bucket, key[0].as_py(), kind, n, raw, payload), strict=True):
            out[name].append(value)

    if chunk.num_rows and flags.num_rows:
        buf, ids, found = _runs_of(chunk, unit, seed, window)
        flags = flags.sort_by("bucket")
        flag = np.frombuffer(b"".join(flags.column("flags").to_pylist()), np.uint8)
        _, many = K.runs(found["anchor"])
        found["flag"] = np.repeat(flag, many)

        def settle_here(entries: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, ...]]:
            """Contexts that an earlier document of the chunk has are gone; the rest must be asked for."""
            first, many = K.runs(entries["anchor"], entries["context"])
            leader = np.repeat(first, many)
            doc, size = ids[entries["row"]], entries["to"] - entries["from"]
            later = (doc > doc[leader]) & (size == size[leader])
            at = np.flatnonzero(later)
            later[at] = _alike(buf, entries["from"][at], entries["from"][leader[at]], size[at])
            return {k: v[~later] for k, v in entries.items()}, tuple(entries[k][later] for k in ("row", "start", "count"))

        rest, gone = settle_here(found)
        asked = {k: v[rest["flag"] == 1] for k, v in rest.items()}
        burst = {k: v[rest["flag"] == 2] for k, v in rest.items()}
        if len(burst["row"]):
            parts = [_windows_apart({k: v[i:j] for k, v in burst.items()}, buf, unit, window) for i, j in K.blocks(np.append(0, np.cumsum(burst["to"] - burst["from"])))]
            single = {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}
            order = np.lexsort((single["row"], single["context"], single["anchor"]))
            single, more = settle_here({k: v[order] for k, v in single.items()})
            gone = tuple(np.concatenate(x) for x in zip(gone, more, strict=True))
            asked = {k: np.concatenate([asked[k], single[k]]) for k in asked}
        asked["doc"] = ids[asked["row"]]
        bucket = _bucket(asked["anchor"], buckets)
        order = np.argsort(bucket, kind="stable")
        asked, bucket = {k: v[order] for k, v in asked.items()}, bucket[order]
        for start, many in zip(*K.runs(bucket), strict=True):
            put(int(bucket[start]), 0, *_pack(asked, slice(start, start + many), buf))
        if len(gone[0]):  # a message that the bucket hands back
            raw = np.stack(gone).astype(np.uint32).tobytes()
            put(key[0].as_py() % buckets, 1, len(gone[0]), len(raw), pa.compress(raw, codec="zstd", asbytes=True))
    return pa.table(out, schema=kinds)


def first_by_suffixes(buf: np.ndarray, offsets: np.ndarray, group: np.ndarray, doc: np.ndarray, count: np.ndarray, *, window: int, **_) -> np.ndarray:
    """For every window of the contexts: the least document that holds it, by suffix arrays.

    The contexts of one anchor form one text; in its suffix array, windows that are equal
    stand side by side.
    """
    size = np.diff(offsets)
    out = np.repeat(doc, count)
    at_window = np.append(0, np.cumsum(count))
    first, many = K.runs(group)
    text_size = np.add.reduceat(size + 1, first) + 1 if len(first) else first
    by_size = np.argsort(text_size, kind="stable")
    batch = np.cumsum(text_size[by_size]) >> BATCH_BITS
    alike = np.log2(np.maximum(text_size[by_size], 1)).astype(np.int64)  # texts of a batch take about as many steps
    for s, m in zip(*K.runs(batch, alike), strict=True):
        texts = by_size[s : s + m]
        chosen = K.spans_of(first[texts], many[texts])
        # 0, first context, 0, second context, 0, ..., 0 for every text
        new_text = np.zeros(len(chosen), dtype=np.int64)
        new_text[np.append(0, np.cumsum(many[texts]))[:-1]] = 1
        begin = np.cumsum(size[chosen] + 1 + new_text) - size[chosen] - 1
        bounds = np.append(0, np.cumsum(text_size[texts]))
        symbols = np.zeros(bounds[-1], dtype=np.int64)
        symbols[K.spans_of(begin, size[chosen])] = buf[K.spans_of(offsets[:-1][chosen], size[chosen])].astype(np.int64) + 1
        array = suffix_arrays(symbols, bounds)
        # Suffixes that are windows, in the order of the array.
        number = np.full(len(symbols), -1, dtype=np.int64)
        number[K.spans_of(begin, count[chosen])] = K.spans_of(at_window[:-1][chosen], count[chosen])
        owner = np.zeros(len(symbols), dtype=np.int64)
        owner[bounds[:-1]] = 1
        owner = np.cumsum(owner)
        array = array[number[array] >= 0]
        rows = np.lib.stride_tricks.sliding_window_view(symbols.astype(np.uint16), window)
        same = owner[array[1:]] == owner[array[:-1]]
        for p in range(0, len(same), 1 << 15):  # whole windows are compared, a few at a time
            q = min(p + (1 << 15), len(same))
            same[p:q] &= (rows[array[p + 1 : q + 1]] == rows[array[p:q]]).all(axis=1)
        start = np.flatnonzero(np.append(True, ~same)) if len(array) else array
        number = number[array]
        if len(start):
            out[number] = np.repeat(np.minimum.reduceat(out[number], start), np.diff(np.append(start, len(array))))
    return out


def first_by_extension(buf: np.ndarray, offsets: np.ndarray, group: np.ndarray, doc: np.ndarray, count: np.ndarray, *, seed: int, window: int) -> np.ndarray:
    """For every window of the contexts: the least document that holds it, by extending seeds.

    Where an anchor stands in a context is a seat. Seats of one anchor are extended word by word to the
    left and to the right as far as they agree; a repeat of at least `window` words that comes out takes
    its windows from the later document. In groups of up to `FEW` seats each meets each. In a larger one
    the seeds grow first: what a window has beyond its seed stands at least by half on one side, so
    every seat goes on with the seed that is longer by that half to the right, and with that to the
    left, among those that have the same. Seeds of a whole window are extended from the first document only.
    """
    start, end, of = K.word_spans(buf, offsets)
    begins = np.searchsorted(of, np.arange(len(offsets)))
    words = K.word_numbers(buf, start, end)
    sums = K.prefix_sums(K.word_hashes(buf, start, end))
    owner = np.repeat(np.arange(len(count)), count)
    first_window = np.append(0, np.cumsum(count))
    at = K.spans_of(begins[:-1], count)
    # The seat of a window: where its least seed stands first. It depends on the words of the window alone.
    grams = (K.run_hash(sums, seed) >> U64(28) << U64(28)) | np.arange(max(0, len(words) - seed + 1), dtype=U64)
    seat = (K.sliding_min(grams, window - seed + 1)[at] & U64((1 << 28) - 1)).astype(np.int64)
    once, _ = K.runs(owner, seat)
    context, low = owner[once], seat[once]
    high = low + seed
    out = doc[owner]
    order = np.lexsort((doc[context], group[context]))
    context, low, high, key = context[order], low[order], high[order], group[context[order]]

    def extend(a: np.ndarray, b: np.ndarray) -> None:
        """b loses what it shares with a."""
        for p in range(0, len(a), 1 << 15):
            i, j = a[p : p + (1 << 15)], b[p : p + (1 << 15)]
            x, y = context[i], context[j]
            left = _agree(words, low[i] - 1, low[j] - 1, np.minimum(low[i] - begins[x], low[j] - begins[y]), -1)
            right = _agree(words, low[i], low[j], np.minimum(begins[x + 1] - low[i], begins[y + 1] - low[j]), 1)
            many = left + right - window + 1
            keep = (many > 0) & (right >= high[i] - low[i])
            i, j, x, y, left, many = i[keep], j[keep], x[keep], y[keep], left[keep], many[keep]
            lost = K.spans_of(first_window[y] + low[j] - left - begins[y], many)
            np.minimum.at(out, lost, np.repeat(doc[x], many))

    while len(key):
        first, many = K.runs(key)
        size, whole = np.repeat(many, many), high - low >= window
        leader = np.repeat(first, many)
        later = np.flatnonzero(whole & (leader != np.arange(len(key))))
        extend(leader[later], later)
        small = (size <= FEW) & ~whole
        for step in range(1, min(FEW, int(many.max()))):
            a = np.flatnonzero(small[: len(key) - step] & (key[: len(key) - step] == key[step:]))
            extend(a, a + step)
        large = np.flatnonzero(~small & ~whole)
        half = -(-(window - high[large] + low[large]) // 2)
        grown = []
        for side in (0, 1):
            fits = (high[large] + half <= begins[context[large] + 1]) if side else (low[large] - half >= begins[context[large]])
            e, h = large[fits], half[fits]
            new_low, new_high = (low[e], high[e] + h) if side else (low[e] - h, high[e])
            grown.append((context[e], new_low, new_high, K.mix(K.mix(key[e] + U64(side)) ^ K.range_hash(sums, new_low, new_high))))
        context, low, high, key = (np.concatenate(x) for x in zip(*grown, strict=True))
        order = np.lexsort((doc[context], key))
        context, low, high, key = context[order], low[order], high[order], key[order]
        _, many = K.runs(key)
        met = np.repeat(many, many) > 1
        context, low, high, key = context[met], low[met], high[met], key[met]
    return out


def _agree(words: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, step: int, width: int = 16) -> np.ndarray:
    """How many words agree from a[i] and b[i] on, in the direction of step, room[i] at most."""
    out = np.zeros(len(a), dtype=np.int64)
    live = np.flatnonzero(room > 0)
    while len(live):
        at = out[live][:, None] + np.arange(width)
        inside = at < room[live][:, None]
        at = np.where(inside, at * step, 0)
        same = inside & (words[a[live][:, None] + at] == words[b[live][:, None] + at])
        more = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
        out[live] += more
        live = live[more == width]
    return out


ANSWER = "chunk long, payload binary"


def _settle(messages: pa.Table, *, first_of: Callable[..., np.ndarray], seed: int, window: int) -> pa.Table:
    parts, contents, answers = [], [], []
    for chunk, kind, n, raw, payload in zip(*(messages.column(c) for c in ("chunk", "kind", "n", "raw", "payload")), strict=True):
        if kind.as_py():
            answers.append((chunk.as_py(), pa.decompress(payload.as_buffer(), decompressed_size=raw.as_py(), codec="zstd", asbytes=True)))
            continue
        part, content = _unpack(n.as_py(), raw.as_py(), payload.as_buffer())
        parts.append(part | {"chunk": np.full(n.as_py(), chunk.as_py())})
        contents.append(content)
    if parts:
        entry = {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}
        size = pa.py_buffer(np.append(0, np.cumsum(entry["size"])))
        texts = pa.Array.from_buffers(pa.large_binary(), len(entry["size"]), [None, size, pa.py_buffer(np.concatenate(contents))])
        contents.clear()
        parts.clear()
        content = texts.dictionary_encode().indices.to_numpy()  # equal numbers for equal bytes
        order = np.lexsort((entry["doc"], content, entry["anchor"]))
        first, many = K.runs(entry["anchor"][order], content[order])
        leader = order[first]  # the first document of every distinct context
        chosen = texts.take(pa.array(leader))
        del texts, content  # only the distinct contexts are needed from here on
        offsets = np.frombuffer(chosen.buffers()[1], np.int64)[: len(leader) + 1]
        found = first_of(np.frombuffer(chosen.buffers()[2], np.uint8)[: offsets[-1]], offsets, entry["anchor"][leader], entry["doc"][leader], entry["count"][leader], seed=seed, window=window)
        at = np.append(0, np.cumsum(entry["count"][leader]))[:-1]
        of_class = np.repeat(np.arange(len(leader)), many)
        for i, j in K.blocks(np.append(0, np.cumsum(entry["count"][order])), 1 << 21):
            answers += _lost(order[i:j], at[of_class[i:j]], found, entry)
    return pa.table({"chunk": pa.array([a for a, _ in answers], pa.int64()), "payload": pa.array([b for _, b in answers], pa.binary())})


def _lost(holders: np.ndarray, at: np.ndarray, found: np.ndarray, entry: dict[str, np.ndarray]) -> list[tuple[int, bytes]]:
    """For each chunk, the runs of windows that these holders of contexts lose. at: where found has the windows of their contexts."""
    count = entry["count"][holders]
    owner = np.repeat(holders, count)
    nth = K.spans_of(np.zeros(len(holders), dtype=np.int64), count)
    gone = np.flatnonzero(found[np.repeat(at, count) + nth] < entry["doc"][owner])
    owner, nth = owner[gone], nth[gone]
    first, many = K.runs(owner, nth - np.arange(len(nth)))
    owner, start = owner[first], entry["start"][owner[first]] + nth[first]
    order = np.argsort(entry["chunk"][owner], kind="stable")
    owner, start, many = owner[order], start[order], many[order]
    chunk = entry["chunk"][owner]
    return [(int(chunk[s]), np.stack([entry["row"][owner[s : s + m]], start[s : s + m], many[s : s + m]]).astype(np.uint32).tobytes()) for s, m in zip(*K.runs(chunk), strict=True)]


def _removed(answers: pa.Table, begins: np.ndarray, window: int) -> np.ndarray:
    """Which symbols of the chunk are covered."""
    step = np.zeros(begins[-1] + 1, dtype=np.int64)
    for x in answers.column("payload") if answers.num_rows else ():
        row, start, many = np.frombuffer(x.as_buffer(), np.uint32).reshape(3, -1).astype(np.int64)
        at = begins[row] + start
        np.add.at(step, at, 1)
        np.add.at(step, at + many + window - 1, -1)
    return np.cumsum(step[:-1]) > 0


def _digest(key: tuple, chunk: pa.Table, answers: pa.Table, *, unit: str, window: int, texts: bool) -> pa.Table:
    buf, offsets, _, _, chunk = _rows(chunk, unit)
    n = chunk.num_rows
    if unit == "byte":
        begins = offsets
    else:
        start, end, doc = K.word_spans(buf, offsets)
        begins = np.searchsorted(doc, np.arange(n + 1))
    gone = _removed(answers, begins, window)
    covered = np.append(0, np.cumsum(gone))
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    inner = begins[:-1][np.diff(begins) > 0]
    opens[inner] = gone[inner]
    spans = np.append(0, np.cumsum(opens))
    n_removed, n_spans = covered[begins[1:]] - covered[begins[:-1]], spans[begins[1:]] - spans[begins[:-1]]
    kept, keep = [], ~gone
    for i in range(n):
        if unit == "byte":
            part = buf[offsets[i] : offsets[i + 1]]
            kept.append((part[keep[offsets[i] : offsets[i + 1]]] if n_removed[i] else part).tobytes())
        else:
            words = buf[offsets[i] : offsets[i + 1]].tobytes().split()
            kept.append(b" ".join([words[w] for w in np.flatnonzero(keep[begins[i] : begins[i + 1]])] if n_removed[i] else words))
    out = {
        "doc_id": chunk.column("doc_id").cast(pa.int64()),
        "n_bytes" if unit == "byte" else "n_words": pa.array(np.diff(begins), pa.int64()),
        "n_removed": pa.array(n_removed, pa.int64()),
        "n_spans": pa.array(n_spans, pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
    }
    if texts:
        out["kept_text"] = pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())
    return pa.table(out)


def remove_repeats(documents: DataFrame, unit: str, seed: int, window: int, first_of: Callable[..., np.ndarray], texts: bool = False, hot: int = HOT, chunk_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words or n_bytes, n_removed, n_spans, kept_sha256 (and kept_text) of every document."""
    chunks = pieces(documents, size=chunk_bytes)
    spec = {"unit": unit, "seed": seed, "window": window}
    dealt = documents.select(F.col("doc_id").cast("long"), "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(chunks)).alias("chunk"))
    by_chunk = dealt.groupBy("chunk")
    seeds = by_chunk.applyInArrow(_plain(_seeds, **spec, buckets=chunks), "bucket long, chunk long, payload binary")
    shared = seeds.groupBy("bucket").applyInArrow(_plain(_shared, hot=hot), "chunk long, bucket long, flags binary")
    asked = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(_keyed(_contexts, **spec, buckets=chunks), MESSAGE)
    answers = asked.groupBy("bucket").applyInArrow(_plain(_settle, first_of=first_of, seed=seed, window=window), ANSWER)
    schema = f"doc_id long, {'n_bytes' if unit == 'byte' else 'n_words'} long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_keyed(_digest, unit=unit, window=window, texts=texts), schema)


def _plain(function: Callable, **options) -> Callable[[pa.Table], pa.Table]:
    def of_group(group: pa.Table) -> pa.Table:
        return function(group, **options)

    return of_group


def _keyed(function: Callable, **options) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def with_key(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return function(key, left, right, **options)

    return with_key


def windows_of(text: str | None, unit: str, window: int) -> Iterator[tuple]:
    """Plain windows, for tests."""
    symbols = (text or "").encode() if unit == "byte" else (text or "").encode().split()
    for i in range(len(symbols) - window + 1):
        yield i, bytes(symbols[i : i + window]) if unit == "byte" else tuple(symbols[i : i + window])
