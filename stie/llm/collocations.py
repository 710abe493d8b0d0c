"""Operator 13, phrase collocations, counted in quotient filters.

Texts are lower-cased (A to Z), cut into pieces at punctuation and line ends, and pieces into words. A phrase of 2
to 5 words that occurs at least `least` times in its language is a candidate. Its score is how much more often it
occurs than its parts would meet by chance, at the cut where that is least; a phrase that
stands as often inside a longer candidate goes.

Words are counted first. A phrase that occurs often enough has only words that do, so those alone get ids
(dense, from 1), and every text is written once as ids, with 0 where a piece ends or a rarer word stands. Then
phrases of 2, 3, 4 and 5 words are counted, each size in one pass over the ids: a phrase is
counted if its first and its last words but one are frequent phrases themselves. What is frequent travels as a bitmap of
`sieve_bits` of the keys' leading bits; where keys share a bit, more is counted than need be, and nothing is lost.
Tasks pack and permute the phrases, hold counts in sorted quotient filters (see quotient.py) of about `slots`
phrases, and send one filter a shard; each shard merges its sorted filters into one, exactly. The shards grow in
number with the words, so none grows with the data, and keys are spread by the permutation: a phrase with a third
of all occurrences is one slot of each filter.

The dictionary is broadcast up to `most_words` words. Beyond that, and where the ids of five words are wider than a key
(over 16 million words), Spark joins words to ids and counts arrays of ids instead, with equal results.

A null language is `und`, as are texts marked so. Null and empty texts have no words; a very long text is
read in whole, piece by piece of ids. Repeated rows count each time. An empty table gives none. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stie.llm.common import placed, small, table, written
from stie.llm.kernels import blocks, spans_of, text_buffer, word_spans
from stie.llm.quotient import FILTER_COLUMNS, WIDEST, Packing, filters, merged, summed

LONGEST = 5
#: Fixed by the contract: what ends a piece, and what ends a word.
PIECE_ENDS = [*b".,;:!?", *range(0x0A, 0x0E)]
WORD_ENDS = np.zeros(256, dtype=bool)
WORD_ENDS[[0x20, 0x09, *PIECE_ENDS]] = True
ENDS_PIECE = np.zeros(256, dtype=bool)
ENDS_PIECE[PIECE_ENDS] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
WORDS_A_SHARD = 1 << 20
LEAST_SHARD_BITS = 6


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, int]]:
    """For about a MB of texts at a time: the language of every word, the words, whether a word begins a piece, its text, and the number of texts."""
    buf, offsets = text_buffer(batch.column("text"))
    langs = batch.column("lang_no").to_numpy(zero_copy_only=False)
    for i, j in blocks(offsets, 1 << 20):
        at = offsets[i : j + 1] - offsets[i]
        low = LOWER[buf[offsets[i] : offsets[j]]]
        start, end, doc = word_spans(low, at, WORD_ENDS)
        piece = np.append(0, np.cumsum(ENDS_PIECE[low]))[start]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
        size = end - start
        data = pa.py_buffer(np.ascontiguousarray(low[spans_of(start, size)]))
        words = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), data])
        yield langs[i:j][doc], words, new, doc, j - i


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang_no, word, n. docs: lang_no, text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, words, *_ in _tokens(batch):
                coded = words.dictionary_encode()
                key, n = np.unique(langs * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_counts=True)
                of, code = np.divmod(key, max(1, len(coded.dictionary)))
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), coded.dictionary.take(pa.array(code, pa.int64())).cast(pa.string()), pa.array(n, pa.int64())], ["lang_no", "word", "n"])

    return docs.select("lang_no", "text").mapInArrow(counted, "lang_no long, word string, n long").groupBy("lang_no", "word").agg(F.sum("n").alias("n"))


def _ids_by_broadcast(docs: DataFrame, words: DataFrame) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(words.orderBy("id").select("word").toArrow().column("word").cast(pa.large_string()).combine_chunks())

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, found, new, doc, n in _tokens(batch):
                at = np.arange(len(found)) + np.cumsum(new)
                ids, of = np.zeros((2, len(found) + int(new.sum())), dtype=np.int64)  # a 0 stands before every piece
                ids[at], of[at] = pc.fill_null(pc.index_in(found, value_set=held.value), -1).to_numpy().astype(np.int64) + 1, langs
                ends = np.append(0, np.cumsum(np.bincount(doc, minlength=n) + np.bincount(doc[new], minlength=n)))
                yield pa.RecordBatch.from_arrays([_lists(of, ends), _lists(ids, ends)], ["langs", "ids"])

    return docs.select("lang_no", "text").mapInArrow(numbered, "langs array<int>, ids array<int>")


def _ids_by_join(docs: DataFrame, words: DataFrame) -> DataFrame:
    """The same with a join of every occurrence, for dictionaries of any size."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, found, new, *_ in _tokens(batch):
                at = np.arange(len(found)) + np.cumsum(new)
                yield pa.RecordBatch.from_arrays([pa.array([list(zip(at.tolist(), langs.tolist(), found.to_pylist(), strict=True))], pa.list_(pa.struct([("at", pa.int64()), ("lang_no", pa.int64()), ("word", pa.string())])))], ["words"])

    texts = docs.select("lang_no", "text").mapInArrow(spelled, "words array<struct<at:long,lang_no:long,word:string>>")
    each = texts.withColumn("part", F.monotonically_increasing_id()).select("part", F.explode("words").alias("x")).select("part", "x.*")
    known = each.join(words, "word", "left").select("part", F.struct("at", F.col("lang_no").cast("int").alias("lang_no"), F.coalesce(F.col("id"), F.lit(0)).cast("int").alias("id")).alias("x"))
    parts = known.groupBy("part").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    # a piece begins where the places leave a gap
    step = F.flatten(F.transform("xs", lambda x, i: F.when((i == 0) | (F.get("xs", i - 1)["at"] + 1 < x["at"]), F.array(F.struct(F.lit(0).alias("lang_no"), F.lit(0).alias("id")), F.struct(x["lang_no"], x["id"]))).otherwise(F.array(F.struct(x["lang_no"], x["id"])))))
    return parts.select(step.alias("s")).select(F.transform("s", lambda x: x["lang_no"]).alias("langs"), F.transform("s", lambda x: x["id"]).alias("ids"))


def _bitmap(frequent: DataFrame, packing: Packing, bits: int) -> np.ndarray:
    """The leading bits of frequent phrases as a bitmap of at most 2 ** bits bits, put together in Spark."""
    if bits <= packing.half:
        lead = F.shiftrightunsigned("left", packing.half - bits)
    elif bits >= 2 * packing.half:
        lead = F.shiftleft("left", packing.half).bitwiseOR(F.col("right"))
    else:
        lead = F.shiftleft("left", bits - packing.half).bitwiseOR(F.shiftrightunsigned("right", 2 * packing.half - bits))
    rows = frequent.select(lead.alias("lead")).groupBy(F.shiftrightunsigned("lead", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(lead % 32 as int))")).alias("word")).toArrow()
    held = np.zeros(max(1, (1 << min(bits, 2 * packing.half)) // 32 + 1), dtype=np.uint32)
    held[rows.column("at").to_numpy()] = rows.column("word").to_numpy().astype(np.uint32)
    return held


def _in(held: np.ndarray, lead: np.ndarray) -> np.ndarray:
    at = lead.astype(np.int64)
    return (held[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1


def _keyed(words: DataFrame, packing: Packing) -> DataFrame:
    """lang_no, ids, n with the halves of the keys."""

    def with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = packing.keys(batch.column("lang_no").to_numpy(), [batch.column("id").to_numpy()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left.astype(np.int64)), pa.array(right.astype(np.int64))], [*batch.schema.names, "left", "right"])

    return words.select("lang_no", "id", "n").mapInArrow(with_keys, "lang_no long, id long, n long, left long, right long").select("lang_no", F.array(F.col("id").cast("int")).alias("ids"), "n", "left", "right")


def frequent_phrases(texts: DataFrame, shorter: DataFrame, packing: Packing, least: int, shard_bits: int, slots: int, sieve_bits: int) -> DataFrame:
    """lang_no, ids, n, left, right of the phrases of packing.size words that occur `least` times. texts: langs, ids; shorter: the frequent phrases of one word less."""
    under = Packing(packing.group_bits, packing.word_bits, packing.size - 1)
    held = texts.sparkSession.sparkContext.broadcast(_bitmap(shorter, under, sieve_bits))
    shard_bits, size = min(shard_bits, packing.half), packing.size

    def keys_of(langs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(ids) < size:
            ids = langs = np.zeros(size, dtype=np.int64)
        known = ids != 0
        at = np.flatnonzero(np.logical_and.reduce([known[k : len(ids) - size + 2 + k] for k in range(size - 1)]))
        good = np.zeros(len(ids) + 1, dtype=bool)
        good[at] = _in(held.value, under.leading(*under.keys(langs[at], [ids[at + k] for k in range(size - 1)]), sieve_bits))
        at = np.flatnonzero(good[:-1] & good[1:])
        return packing.keys(langs[at], [ids[at + k] for k in range(size)])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting, n = None, [], 0

        def together():
            parts = [summed(np.concatenate([x[0] for x in waiting]), np.concatenate([x[1] for x in waiting]), None, packing.half)] if waiting else []
            parts += [kept] if kept is not None else []
            return summed(*(np.concatenate(x) for x in zip(*parts, strict=True)), packing.half) if len(parts) > 1 else parts[0] if parts else None

        for batch in batches:
            lists, langs = batch.column("ids"), batch.column("langs").flatten().to_numpy()
            ids, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, j in blocks(ends, 1 << 18):  # texts begin with a 0, so phrases don't cross them
                a, z = ends[i], ends[j]
                for at in range(a, z, 1 << 20):  # a very long text goes in pieces that share what a phrase could cross
                    waiting.append(keys_of(langs[at : min(z, at + (1 << 20) + size - 1)].astype(np.int64), ids[at : min(z, at + (1 << 20) + size - 1)].astype(np.int64)))
                    n += len(waiting[-1][0])
                    if n >= slots:
                        kept, waiting, n = together(), [], 0
                        if len(kept[0]) >= slots:
                            yield filters(kept, packing, shard_bits)
                            kept = None
        kept = together()
        if kept is not None and len(kept[0]):
            yield filters(kept, packing, shard_bits)

    def merge(rows: pa.Table) -> pa.Table:
        left, right, n = merged(rows.to_pylist(), packing, shard_bits)
        often = n >= least
        left, right, n = left[often], right[often], n[often]
        groups, words = packing.words(left, right)
        flat = np.stack(words, axis=1).astype(np.int32).ravel() if len(n) else np.zeros(0, dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * size), pa.array(flat))
        return pa.table([pa.array(groups.astype(np.int64)), ids, pa.array(n.astype(np.int64)), pa.array(left.astype(np.int64)), pa.array(right.astype(np.int64))], names=["lang_no", "ids", "n", "left", "right"])

    sent = texts.mapInArrow(counted, FILTER_COLUMNS)
    return sent.groupBy("shard").applyInArrow(merge, "lang_no long, ids array<int>, n long, left long, right long")


def _counted_by_spark(texts: DataFrame, size: int, least: int) -> DataFrame:
    """The same without packed keys, for ids of any width."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("ids") - size + 1, F.lit(1)))
    grams = texts.select("langs", "ids", F.explode(starts).alias("i")).select(F.get("langs", F.col("i") - 1).cast("long").alias("lang_no"), F.slice("ids", F.col("i"), size).alias("ids"))
    whole = (F.size("ids") == size) & ~F.array_contains("ids", 0)
    return grams.where(whole).groupBy("lang_no", "ids").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("lang_no", "ids", "n", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"))


def phrases(documents: DataFrame, lang: Column, least: int = 100, absorbed: int = 100, most_words: int = 1 << 20, widest: int = WIDEST, slots: int = 1 << 19, sieve_bits: int = 26) -> DataFrame:
    """lang, phrase, words (their number), a, l, r, n, score of every candidate that no longer one absorbs.

    A longer candidate with at least `absorbed` percent of a phrase's occurrences absorbs it.
    """
    docs = documents.select(F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"), "text").where(F.octet_length("text") > 0)
    langs = written(placed(docs.select("lang").distinct().select(F.lit("").alias("tree"), "lang"), ["lang"]).select("lang", F.col("at").alias("lang_no")))
    docs = docs.join(small(langs), "lang").select("lang_no", "text")
    counts = written(word_counts(docs))
    totals = written(counts.groupBy("lang_no").agg(F.sum("n").alias("total")))
    often = counts.where(F.col("n") >= least)
    words = written(placed(often.select(F.lit("").alias("tree"), "word").distinct(), ["word"]).select("word", (F.col("at") + 1).alias("id")))
    n_words, n_langs = words.count(), langs.count()
    group_bits, word_bits = max(1, int(n_langs).bit_length()), max(1, int(n_words).bit_length())
    texts = written((_ids_by_broadcast if n_words <= most_words else _ids_by_join)(docs, words))
    shards = (totals.agg(F.sum("total")).first()[0] or 0) // WORDS_A_SHARD
    shard_bits = max(LEAST_SHARD_BITS, int(shards).bit_length())

    packing = Packing(group_bits, word_bits, 1)
    found = [written(_keyed(often.join(small(words), "word"), packing))]
    for size in range(2, LONGEST + 1):
        packing = Packing(group_bits, word_bits, size)
        if group_bits + size * word_bits <= widest:
            more = frequent_phrases(texts, found[-1], packing, least, shard_bits, slots, sieve_bits)
        else:
            more = _counted_by_spark(texts, size, least)
        found.append(written(more))
    known = found[0]
    for more in found[1:]:
        known = known.unionByName(more)
    return _named(_scored(known.select("lang_no", "ids", "n"), totals, absorbed), langs, words)


def _scored(known: DataFrame, totals: DataFrame, absorbed: int) -> DataFrame:
    """lang_no, ids, a, l, r, total, score of the candidates that stay."""
    several = known.where(F.size("ids") >= 2)
    cuts = several.select("lang_no", "ids", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("ids", F.lit(1), F.col("k")).alias("front"), F.slice("ids", F.col("k") + 1, F.size("ids")).alias("rear"))
    part = lambda name, n: known.select("lang_no", F.col("ids").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("front", "l"), ["lang_no", "front"]).join(part("rear", "r"), ["lang_no", "rear"]).join(small(totals), "lang_no")
    cuts = cuts.withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(total as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"))
    best = cuts.groupBy("lang_no", "ids").agg(F.first("a").alias("a"), F.first("total").alias("total"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    places = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("ids") - m + 1), lambda i: F.slice("ids", i, m))))
    inside = several.where(F.size("ids") >= 3).select("lang_no", F.explode(places).alias("ids"), F.col("n").alias("longer")).groupBy("lang_no", "ids").agg(F.max("longer").alias("longer"))
    stay = best.join(inside, ["lang_no", "ids"], "left").where(F.coalesce(100 * F.col("longer") < absorbed * F.col("a"), F.lit(True)))
    return stay.select("lang_no", "ids", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "total", F.col("cut.score").alias("score"))


def _named(scored: DataFrame, langs: DataFrame, words: DataFrame) -> DataFrame:
    each = scored.select("lang_no", "ids", F.posexplode("ids").alias("at", "id")).join(small(words), "id")
    spelled = each.groupBy("lang_no", "ids").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return scored.join(spelled, ["lang_no", "ids"]).join(small(langs), "lang_no").select("lang", "phrase", F.size("ids").alias("words"), "a", "l", "r", F.col("total").alias("n"), "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of every language."""
    found = phrases(table(spark, sf_dir, "documents"), F.col("lang"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase")))
    return found.withColumn("rank", rank).where("rank <= 2000").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, ph, len(ph) AS m, count(*) AS f FROM (SELECT lang, ws[i:i + m - 1] AS ph FROM (SELECT lang, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m))) GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, ph, m, f AS a, unnest(generate_series(1, m - 1)) AS k FROM g WHERE m >= 2),
s AS (SELECT c.lang, c.ph, c.m, a, k, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM c JOIN g x ON x.lang = c.lang AND x.ph = c.ph[:k] JOIN g y ON y.lang = c.lang AND y.ph = c.ph[k + 1:] JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) AS nth FROM s) WHERE nth = 1),
i AS (SELECT lang, ph[i:i + k - 1] AS ph, max(f) AS longer FROM (SELECT lang, ph, m, f, k, unnest(generate_series(1, m - k + 1)) AS i FROM (SELECT lang, ph, m, f, unnest(generate_series(2, m - 1)) AS k FROM g WHERE m >= 3)) GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM b LEFT JOIN i ON i.lang = b.lang AND i.ph = b.ph WHERE NOT coalesce(100 * longer >= 100 * a, false))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o) WHERE rank <= 2000
"""
