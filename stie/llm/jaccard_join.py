"""Operator 10, n-gram Jaccard join with Bayesian candidate pruning.

Two documents are linked if their sets of hashed 5-word shingles have a Jaccard similarity of
0.8 or more (words as `[^\\x20\\x09-\\x0D]+`, unchanged; a text of one to four words is one
shingle). The steps:

1. Every document gets its set's 128-bit key and 152 MinHash values. Documents with one key
   are a class; the text of its document with the least id stands for it from here on.
2. The values form 38 bands of 4; a pair at 0.8 misses all bands with a probability of
   2e-9. Representatives that share a band are candidates. Their values are compared 38 at a
   time, and a pair is dropped as soon as the posterior probability (uniform prior) of
   reaching the threshold is below `tolerance`. What is left hangs together in candidate
   clusters; a bucket is reported by at most one edge a member.
3. The texts of cluster members are fetched once, and all pairs of a cluster whose set sizes
   allow the threshold are pruned in the same way and then verified on the whole sets.

No pairs are shuffled. Small clusters are packed into units of work by members and shingles; a large
one is cut into blocks by size and hash, and every two blocks that may hold links meet in a unit of their
own, so a unit's memory is bounded. Each unit returns, per document, its number of links and the least document it hangs on,
so what comes out grows with the documents. A bucket with more than `crowd` members joins its
members to one cluster without comparing them, which loses no link.

Long texts are shingled whole, in blocks. Of other columns, whatever their names, none is read. An empty
table gives an empty result. Null and empty texts have no set: each is a class of its own without links. Rows with a null
doc_id come out with a null class and no links. Rows that repeat are copies of each other. Classes
are numbered, and ids come in only at the end: texts that share an id are compared each on its
own, and each row has the class and the links of its own text. Two classes that don't hang
together have one class_id only if their least ids are the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from stie.llm import kernels as K
from stie.llm.common import reliable, table
from stie.llm.components import components

U64 = np.uint64
BANDS, ROWS = 38, 4
VALUES = BANDS * ROWS
STEP = 38
BLOCK = 256
UNIT = 1024
UNIT_SHINGLES = 1 << 19  # of packed clusters together; a block of a large cluster has twice as many at most

_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)
_ODD = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of documents: first, last, the distinct shingles one document after the other, and where each begins."""
    buf, offsets = K.text_buffer(texts)
    for i, j in K.blocks(offsets):
        part, bounds = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, doc = K.word_spans(part, bounds)
        words = K.word_hashes(part, start, end)
        begins = np.searchsorted(doc, np.arange(j - i + 1))
        count = np.diff(begins)
        sums = K.prefix_sums(words)
        many = np.where(count >= size, count - size + 1, np.minimum(count, 1))
        at = K.spans_of(begins[:-1], many)
        owner = np.repeat(np.arange(j - i), many)
        values = K.range_hash(sums, at, at + np.minimum(size, count[owner]))
        order = np.lexsort((values, owner))
        owner, values = owner[order], values[order]
        first, _ = K.runs(owner, values)
        yield i, j, values[first], np.searchsorted(owner[first], np.arange(j - i + 1))


def minhash(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """16 bits of each of the MinHash values of every non-empty set."""
    folded = (values ^ (values >> U64(32))).astype(np.uint32)
    out = np.empty((VALUES, len(begins) - 1), dtype=np.uint16)
    for p in range(0, VALUES, 4):
        hashed = (folded[None, :] ^ _XOR[p : p + 4, None]) * _ODD[p : p + 4, None]
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        least = np.minimum.reduceat(hashed, begins[:-1], axis=1)
        out[p : p + 4] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return np.ascontiguousarray(out.T)


def _signatures(size: int):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(2)
            for i, j, values, begins in shingle_sets(batch.column(1), size):
                count = np.diff(begins)
                full = np.flatnonzero(count)
                key, sig = [None] * (j - i), [None] * (j - i)
                if len(full):
                    starts = begins[:-1][full]
                    one = np.add.reduceat(K.mix(values), starts)
                    two = np.add.reduceat(K.mix(values ^ U64(0x5851F42D4C957F2D)), starts)
                    keys = np.stack([one, two], axis=1)
                    for n, k, s in zip(full, keys, minhash(values, np.append(starts, begins[-1])), strict=True):
                        key[n], sig[n] = k.tobytes(), s.tobytes()
                yield pa.RecordBatch.from_arrays([ids[i:j], hashes[i:j], pa.array(key, pa.binary()), pa.array(count, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "text_hash", "key", "n", "sig"])

    return of_batches


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, VALUES)
        keys = K.mix(np.ascontiguousarray(sig).view(np.uint64).reshape(-1, BANDS) ^ K.mix(np.arange(1, BANDS + 1, dtype=U64)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["band", "doc"])


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """After n values, the least number of matches with which a pair goes on.

    With a uniform prior, the similarity's posterior after m matches in n is Beta(m + 1, n - m + 1),
    and P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        out.append((n, m))
    return out


def prune(sig: np.ndarray, a: np.ndarray, b: np.ndarray, needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose posterior stays above the tolerance at every step."""
    matches, done = np.zeros(len(a), dtype=np.int64), 0
    for n, least in needed:
        matches = matches + (sig[a, done:n] == sig[b, done:n]).sum(axis=1)
        keep = matches >= least
        a, b, matches, done = a[keep], b[keep], matches[keep], n
    return a, b


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of everyone's component; members are numbered in the order of their ids."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _pairs(n: int, m: int | None = None, limit: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n members, or of each of n with each of m, in bounded pieces."""
    step = max(1, limit // max(1, n if m is None else m))
    for p in range(0, n, step):
        rows = np.arange(p, min(p + step, n))
        a, b = np.repeat(rows, n if m is None else m), np.tile(np.arange(n if m is None else m), len(rows))
        if m is None:
            keep = a < b
            a, b = a[keep], b[keep]
        yield a, b if m is None else b + n


def _candidates(needed: list[tuple[int, int]], crowd: int):
    """Edges among the members of each band; the rows come in the order of (band, doc)."""

    def edges_of(docs: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        kept = [prune(sig, a, b, needed) for a, b in _pairs(len(docs))]
        if kept:
            root = _roots(len(docs), np.concatenate([a for a, _ in kept]), np.concatenate([b for _, b in kept]))
            at = np.flatnonzero(root != np.arange(len(docs)))
            yield docs[root[at]], docs[at]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, docs, sigs, crowded = None, np.zeros(0, np.int64), np.zeros((0, VALUES), np.uint16), False

        def close() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if not crowded and len(docs) > 1:
                yield from edges_of(docs, sigs)

        for batch in batches:
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, VALUES)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            first, many = K.runs(keys)
            pair = np.flatnonzero(many[1:-1] == 2) + 1  # the many bands of two, all together
            a, b = prune(sig, first[pair], first[pair] + 1, needed)
            out.append((ids[a], ids[b]))
            for n, (f, m) in enumerate(zip(first, many, strict=True)):
                if 0 < n < len(first) - 1 and m == 2:
                    continue
                if keys[f] != band:
                    out += close()
                    band, docs, sigs, crowded = keys[f], ids[:0], sig[:0], False
                docs, sigs = np.append(docs, ids[f : f + m]), np.vstack([sigs, sig[f : f + m]])
                if crowded or len(docs) > crowd:  # one edge each, and only the first stays
                    out.append((np.repeat(docs[:1], len(docs) - 1), docs[1:]))
                    docs, sigs, crowded = docs[:1], sigs[:1], True
            yield from _edge_batches(out)
        yield from _edge_batches(close())

    return of_batches


def _edge_batches(edges) -> Iterator[pa.RecordBatch]:
    edges = list(edges)
    if edges:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[k] for e in edges]), pa.int64()) for k in (0, 1)], ["a", "b"])


def _members(size: int):
    """unit and side of each member's work, and its set and values."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            text = names.index("text")
            for i, j, values, begins in shingle_sets(batch.column(text), size):
                part = batch.slice(i, j - i)
                sets = [values[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names)) if k != text), pa.array(sets, pa.binary())], [*(n for n in names if n != "text"), "set"])

    return of_batches


LINKS = "doc long, links long, texts long, root long"


def _verify(threshold: float, needed: list[tuple[int, int]]):
    """Links of the pairs of one unit: within each cluster, or between the two sides of a pair of blocks."""

    def links_of(sets: list[bytes], sig: np.ndarray, copies: np.ndarray, left: int | None):
        n = len(sets)
        size = np.array([len(s) // 8 for s in sets])
        flat = np.frombuffer(b"".join(sets), U64)
        words, local = np.unique(flat, return_inverse=True)
        # A shingle of one member only can't be shared: it needs no bit.
        held = np.bincount(local, minlength=len(words)) > 1
        number = np.cumsum(held) - 1
        shared = held[local]
        bits = np.zeros((n, int(held.sum()) // 64 + 1), dtype=U64)
        owner = np.repeat(np.arange(n), size)[shared]
        at = number[local[shared]]
        np.bitwise_or.at(bits, (owner, at >> 6), U64(1) << (at & 63).astype(U64))
        links, texts, one, two = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
        for a, b in _pairs(n) if left is None else _pairs(left, n - left):
            keep = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
            a, b = prune(sig, a[keep], b[keep], needed)
            step = max(1, (4 << 20) // (8 * bits.shape[1]))
            for p in range(0, len(a), step):
                x, y = a[p : p + step], b[p : p + step]
                both = np.bitwise_count(bits[x] & bits[y]).sum(axis=1).astype(np.int64)
                keep = both >= threshold * (size[x] + size[y] - both) - 1e-9
                x, y = x[keep], y[keep]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                np.add.at(texts, x, 1)
                np.add.at(texts, y, 1)
                one.append(x)
                two.append(y)
        return links, texts, np.concatenate(one) if one else np.zeros(0, np.int64), np.concatenate(two) if two else np.zeros(0, np.int64)

    def of_unit(unit: pa.Table) -> pa.Table:
        unit = unit.sort_by([("cluster", "ascending"), ("side", "ascending"), ("doc", "ascending")])
        doc, cluster, copies = (unit.column(c).to_numpy() for c in ("doc", "cluster", "copies"))
        side = unit.column("side").to_numpy()
        sets = unit.column("set").to_pylist()
        sig = np.frombuffer(b"".join(unit.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
        out = [[], [], [], []]
        for f, m in zip(*K.runs(cluster), strict=True):
            left = None if side[f] == 0 else int((side[f : f + m] == 1).sum())
            if left in (0, m):  # the other block is empty
                continue
            links, texts, a, b = links_of(sets[f : f + m], sig[f : f + m], copies[f : f + m], left)
            order = np.argsort(doc[f : f + m], kind="stable")
            rank = np.empty(m, dtype=np.int64)
            rank[order] = np.arange(m)
            root = doc[f : f + m][order][_roots(m, rank[a], rank[b])][rank]
            some = np.flatnonzero(texts)
            for store, value in zip(out, (doc[f : f + m], links, texts, root), strict=True):
                store.append(value[some])
        empty = np.zeros(0, dtype=np.int64)
        return pa.table({n: pa.array(np.concatenate([empty, *x]), pa.int64()) for n, x in zip(("doc", "links", "texts", "root"), out, strict=True)})

    return of_unit


def jaccard_classes(documents: DataFrame, threshold: float = 0.8, size: int = 5, tolerance: float = 1e-9, crowd: int = 512, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows: doc_id, key of every document; classes: key, doc_id (its least), class_id, first, n_links, n_texts.

    `first` is true for one class of those that hang together: the one that holds class_id. Inside,
    `doc` is the number of a class, not an id, since different texts can share an id.
    """
    needed = least_matches(threshold, tolerance)
    read = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    signed = reliable(read.mapInArrow(_signatures(size), "doc_id long, text_hash long, key binary, n long, sig binary"))
    usable = signed.where(F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    held = F.struct("doc_id", "text_hash")
    grouped = usable.groupBy("key").agg(F.min(held).alias("held"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min_by("sig", held).alias("sig"))
    classes = reliable(grouped.select("key", F.monotonically_increasing_id().alias("doc"), "held.doc_id", "held.text_hash", "copies", "n", "sig"))

    bands = classes.select("doc", "sig").mapInArrow(_bands, "band long, doc long")
    met = bands.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("band")
    meeting = bands.join(met, "band").join(classes.select("doc", "sig"), "doc").select("band", "doc", "sig")
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = meeting.repartition(partitions, "band").sortWithinPartitions("band", "doc").mapInArrow(_candidates(needed, crowd), "a long, b long")
    hung = components(edges)
    clusters = reliable(hung.select(F.col("node").alias("doc"), F.col("root").alias("cluster")).unionByName(hung.select(F.col("root").alias("doc"), F.col("root").alias("cluster")).distinct()))

    found = reliable(_links(read, classes, clusters, threshold, size, needed, block))
    roots = components(found.select(F.col("doc").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("doc").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    known = classes.select("key", "doc", "doc_id", "copies").join(sums, "doc", "left").join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    lowest = known.groupBy("root").agg(F.min(F.struct("doc_id", "doc")).alias("low"))
    known = known.join(lowest, "root").select(
        "key", "doc_id", F.col("low.doc_id").alias("class_id"), (F.col("low.doc") == F.col("doc")).alias("first"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts"),
    )
    return signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")), known


def jaccard_join(documents: DataFrame, threshold: float = 0.8, size: int = 5, tolerance: float = 1e-9, crowd: int = 512, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (the least doc_id it hangs together with), n_links (linked documents), n_texts (linked distinct sets)."""
    rows, known = jaccard_classes(documents, threshold, size, tolerance, crowd, block)
    return (
        rows.join(known.drop("doc_id", "first"), "key", "left")
        .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"))
    )


def _keys(size: int):
    """The rows with the key of their text's set."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(np.zeros(batch.num_rows, dtype=np.int64))
            alone = pa.RecordBatch.from_arrays([ids, batch.column("text"), ids], ["doc_id", "text", "text_hash"])
            keys = [part.column("key") for part in _signatures(size)(iter([alone]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays([*keys, pa.array([], pa.binary())])], [*batch.schema.names, "key"])

    return of_batches


def without_near_duplicates(documents: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """One document of all that hang together, that with the least id; texts that share an id are judged each on its own.

    Rows of an id that repeat stay once. Null ids stay, as do null and empty texts.
    """
    rows, known = jaccard_classes(documents.select("doc_id", "text"), threshold, size)
    stay = known.where("first").select("key", F.col("doc_id").alias("first_id"))
    ids = documents.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("rows"))
    shared = ids.where(F.col("rows") > 1).select("doc_id")
    gone = rows.where(F.col("key").isNotNull()).join(stay, "key", "left").where(F.col("first_id").isNull() | (F.col("first_id") != F.col("doc_id"))).select("doc_id").distinct()
    if shared.isEmpty():
        return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
    single = documents.join(shared, "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(*documents.columns)
    keyed = documents.join(shared, "doc_id", "left_semi").select(*documents.columns).mapInArrow(_keys(size), StructType([*documents.schema.fields, StructField("key", BinaryType())]))
    full = keyed.where(F.col("key").isNotNull()).join(stay, "key").where(F.col("first_id") == F.col("doc_id")).dropDuplicates(["doc_id", "key"])
    empty = keyed.where(F.col("key").isNull()).dropDuplicates(["doc_id", "text"])
    return single.unionByName(full.select(*documents.columns)).unionByName(empty.select(*documents.columns))


def _links(read: DataFrame, classes: DataFrame, clusters: DataFrame, threshold: float, size: int, needed: list[tuple[int, int]], block: int) -> DataFrame:
    """doc, links, texts, root, once for every unit of work that a document has links in."""
    members = classes.select("doc", "doc_id", "text_hash", "copies", "n", "sig").join(clusters, "doc")
    # Only neighbouring levels can hold linked sets.
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold))).cast("int")
    members = members.withColumn("level", level)
    sizes = members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("m_shingles"))
    levels = members.groupBy("cluster", "level").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / (2 * UNIT_SHINGLES))).cast("int").alias("cuts"))
    above = levels.select("cluster", (F.col("level") - 1).alias("level"), F.col("cuts").alias("cuts_above"))
    below = levels.select("cluster", (F.col("level") + 1).alias("level"), F.col("cuts").alias("cuts_below"))
    shape = levels.join(above, ["cluster", "level"], "left").join(below, ["cluster", "level"], "left").join(sizes, "cluster").fillna(0, ["cuts_above", "cuts_below"])
    total = members.agg(F.count("*").alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    units = max(1, -(-total.m // UNIT), -(-total.shingles // UNIT_SHINGLES))
    cut = F.pmod(F.xxhash64("doc"), F.col("cuts").cast("long")).cast("int")
    name = lambda low, a, b, kind: F.struct(F.col("cluster").alias("c"), low.alias("l"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(kind).alias("k"))
    job = lambda unit, side: F.struct(unit.alias("unit"), F.lit(side).alias("side"))
    zero = F.lit(0)
    steps = lambda low, high: F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    packed = F.array(F.struct(F.struct(F.pmod(F.xxhash64("cluster"), F.lit(units)).alias("c"), zero.alias("l"), zero.alias("a"), zero.alias("b"), F.lit("all").alias("k")).alias("unit"), zero.alias("side")))
    own = F.array(job(name(F.col("level"), F.col("cut"), F.col("cut"), "own"), 0))
    first = F.transform(steps(F.col("cut") + 1, F.col("cuts") - 1), lambda o: job(name(F.col("level"), F.col("cut"), o, "same"), 1))
    second = F.transform(steps(zero, F.col("cut") - 1), lambda o: job(name(F.col("level"), o, F.col("cut"), "same"), 2))
    low = F.transform(steps(zero, F.col("cuts_above") - 1), lambda o: job(name(F.col("level"), F.col("cut"), o, "next"), 1))
    high = F.transform(steps(zero, F.col("cuts_below") - 1), lambda o: job(name(F.col("level") - 1, o, F.col("cut"), "next"), 2))
    jobs = F.when((F.col("m") <= block) & (F.col("m_shingles") <= 2 * UNIT_SHINGLES), packed).otherwise(F.concat(own, first, second, low, high))
    planned = members.join(shape, ["cluster", "level"]).withColumn("cut", cut).select("doc", "doc_id", "text_hash", "copies", "cluster", "sig", jobs.alias("jobs"))
    once = read.where(F.col("doc_id").isNotNull()).join(planned, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("text", "doc", "copies", "cluster", "sig", "jobs")
    work = once.mapInArrow(_members(size), "doc long, copies long, cluster long, sig binary, jobs " + planned.schema["jobs"].dataType.simpleString() + ", set binary")
    return work.withColumn("job", F.explode("jobs")).select("doc", "copies", "cluster", "sig", "set", "job.side", F.col("job.unit").alias("unit")).groupBy("unit").applyInArrow(_plain_verify(threshold, needed), LINKS)


def _plain_verify(threshold: float, needed: list[tuple[int, int]]):
    verify = _verify(threshold, needed)

    def of_unit(unit: pa.Table) -> pa.Table:
        return verify(unit.drop_columns(["unit"]))

    return of_unit


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
