"""Operator 1, substring dedup: seed and extend on words.

Documents are joined on winnowed anchors (seeds of 12 words); each match is extended to both
sides, and repeats of at least `window` words are kept as the maximal runs of matching
windows. See repeats.py for the flow. Empty and null texts have no words and lose none; a
document shorter than the window loses none. Of rows with one doc_id none takes from another; a null doc_id neither
takes nor loses. Long texts are read whole. An empty table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stie.llm.common import table
from stie.llm.repeats import first_by_extension, remove_repeats


def substring_dedup(documents: DataFrame, window: int = 50, seed: int = 12, texts: bool = False, **options) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256 and, if `texts`, kept_text."""
    return remove_repeats(documents, "word", seed, window, first_by_extension, texts, **options)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256", "n_spans")
