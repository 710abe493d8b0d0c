"""What the three classifiers share: their bounded training samples and hashed features.

Models are fitted on at most `rows` labelled documents outside the held-out fold, taken in the
order of a hash of their ids: the same ones in every run, whatever the partitions. Of rows with one id,
one text is learned from, so an id that very many rows have takes no more room than any other. All
documents are scored, where they lie, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stie.llm import kernels as K
from stie.llm.common import held_out, reliable

U64 = np.uint64


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """doc_id, text, label of the training rows; documents and labels are joined on doc_id."""
    chosen = (
        labels.select(F.col("doc_id").cast("long"), F.col(target).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(rows)
    )
    return one_text(documents.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id"), "label")


def one_text(rows: DataFrame, label: str) -> DataFrame:
    """doc_id, text and label: of each id and label the text with the least hash; a partial minimum, so no id gathers its rows."""
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")
    return reliable(rows.groupBy("doc_id", label).agg(least).select("doc_id", F.col("least.text").alias("text"), label))


def ngram_counts(buf: np.ndarray, offsets: np.ndarray, dims: int, orders: tuple[int, ...] = (1, 2, 3)) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks of documents with their counts of hashed byte n-grams, of the whole texts."""
    seeds = {n: np.uint32(0x9E3779B1 * n & 0xFFFFFFFF | 1) for n in orders}
    for i, j in K.blocks(offsets, 1 << 20):
        for a in range(i, j, 512):
            b = min(a + 512, j)
            part, bounds = buf[offsets[a] : offsets[b]].astype(np.uint32), offsets[a : b + 1] - offsets[a]
            doc = np.repeat(np.arange(b - a), np.diff(bounds))
            counts = np.zeros((b - a) * dims, dtype=np.int64)
            code = np.zeros(len(part), dtype=np.uint32)
            for n in range(1, max(orders) + 1):
                size = len(part) - n + 1
                if size <= 0:
                    break
                code = code[:size] * np.uint32(257) + part[n - 1 :] + np.uint32(1)
                if n in seeds:
                    whole = doc[:size] == doc[n - 1 :]
                    slot = ((code * seeds[n]) >> np.uint32(8)).astype(np.int64) % dims
                    counts += np.bincount((doc[:size] * dims + slot)[whole], minlength=len(counts))
            yield a, b, counts.reshape(b - a, dims)


def scored(documents: DataFrame, score, fields: str, columns: list[str] | None = None) -> DataFrame:
    """doc_id, held_out and the fields that score(texts) returns as arrays, for every document."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score(batch.column(2), batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found.values()], ["doc_id", "held_out", *found])

    sent = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text", *(columns or []))
    return sent.mapInArrow(of_batches, f"doc_id long, held_out boolean, {fields}")
