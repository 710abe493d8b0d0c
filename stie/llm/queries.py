"""The llm queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stie.llm.collocations import OP13_SQL, op13_collocations
from stie.llm.decontaminate import op5_decontaminate
from stie.llm.jaccard_join import op10_jaccard_join
from stie.llm.language_id import op3_language_id
from stie.llm.licenses import OP12_SQL, op12_license_scan
from stie.llm.line_dedup import OP7_SQL, op7_line_dedup
from stie.llm.merkle import OP11_SQL, op11_merkle_manifest
from stie.llm.mixing import OP8_SQL, op8_mix
from stie.llm.quality import op6_quality
from stie.llm.substring_dedup import op1_substring_dedup
from stie.llm.suffix_dedup import op4_suffix_array_dedup
from stie.llm.topk import OP9_SQL, op9_top_k
from stie.llm.toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_line_dedup": op7_line_dedup,
    "op8_mix": op8_mix,
    "op9_top_k": op9_top_k,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_license_scan": op12_license_scan,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op7_line_dedup": OP7_SQL,
    "op8_mix": OP8_SQL,
    "op9_top_k": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_license_scan": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
