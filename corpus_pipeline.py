"""The corpus pipeline: five stages over documents, each with one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents; other columns are
left behind by the first stage, whatever their names. Every stage takes an empty table and gives one, and reads very
long texts whole. Rows that repeat are treated alike, but where a stage says that one stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stie.llm.common import shared_folder, table
from stie.llm.decontaminate import without_contaminated
from stie.llm.jaccard_join import without_near_duplicates
from stie.llm.line_dedup import line_dedup, text_lines
from stie.llm.mixing import mixed_documents
from stie.llm.toxicity import fit_toxicity, without_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go.

    Null and empty texts are scored as texts without terms; a null id, language or source doesn't matter. A score of exactly 0.5 rejects.
    """
    docs = docs.select(*COLUMNS)
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that more than a tenth of a source's documents hold go; the documents stay, and n_chars follows the text.

    Documents without a source, and null or empty texts, lose nothing. A share of exactly a tenth stays.
    """
    docs = docs.select(*COLUMNS)
    found = line_dedup(docs, F.col("source"), text_lines(F.col("text")))
    text = F.when(F.col("n_dropped") > 0, F.array_join("kept", "\n")).otherwise(F.col("text"))
    chars = F.when(F.col("n_dropped") > 0, F.length(text)).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", chars.cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by links of 0.8 or more, the one with the least id stays.

    Where rows share an id, each text is judged on its own: it isn't lost with another one's copy. Rows of
    one id and text stay once. Null and empty texts, and rows without an id, stay.
    """
    return without_near_duplicates(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Null and empty texts, of either side, hold nothing."""
    return without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; `copy` numbers its copies.

    A null source is a source. Null and empty texts have no words, but are drawn at their source's rate like the rest.
    """
    return mixed_documents(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mixing),
]

#: The first stages learn and search beyond what SQL can express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written to the shared folder and read again; a stage's output is deleted when the next one's is there."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for n, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if n + 1 == len(STAGES):
            return out
        path = f"{folder}/{n}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    """Through Hadoop's file system, as the folder may be anywhere."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
