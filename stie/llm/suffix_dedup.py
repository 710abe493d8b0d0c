"""Operator 4, suffix-array dedup: linear grouping on the bytes that may repeat.

The suffix arrays are built by Lyndon-prefix groups (suffix.py), one for all distinct
contexts of an anchor (repeats.py). Matches never cross documents, since every context is
part of one document and contexts are cut apart. Null texts are empty; texts shorter than
`window` bytes lose nothing. Of rows with one doc_id none takes from another; a null doc_id neither takes
nor loses. Long texts are read whole. An empty table gives an empty result, and other columns are not read.

Equal contexts are one string of the text that is sorted, with their least document; they are known by
their bytes. Every distinct context is sorted, also one that stands alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stie.llm.common import table
from stie.llm.repeats import first_by_suffixes, remove_repeats


def suffix_dedup(documents: DataFrame, window: int = 50, seed: int = 24, texts: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if `texts`, kept_text (bytes that no longer form UTF-8 are replaced there)."""
    return remove_repeats(documents, "byte", seed, window, first_by_suffixes, texts, **options)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
