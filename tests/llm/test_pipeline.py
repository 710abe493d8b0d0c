"""The pipeline and the registered llm queries, against SQL and stage by stage."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stie.llm import queries as registry
from tests.test_catalogue import TABLES, aligned


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, expected = aligned(registry.QUERIES[name](spark, sf).toPandas()), aligned(duck.sql(registry.ORACLES[name]).df())
    assert list(got.columns) == list(expected.columns) and got.equals(expected)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("row", F.lit(1))
    counts = [docs.count()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if n < 4:
            assert out.columns == corpus_pipeline.COLUMNS, name
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        counts.append(docs.count())
    toxic, lined, near, clean, _ = counts[1:]
    assert counts[0] > toxic and toxic == lined and lined > near >= clean
    final = docs.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert final <= 3
    near_docs = spark.read.parquet(f"{tmp_path}/2").collect()
    from tests.llm.test_llm import brute_links

    assert all(n == 0 for _, n in brute_links([(r.doc_id, r.text) for r in near_docs]).values())


def test_run_is_the_stages(spark, sf):
    a, b = (sorted((r.doc_id, r.copy) for r in corpus_pipeline.run(spark, sf).select("doc_id", "copy").collect()) for _ in range(2))
    assert a == b and a


def test_stages_on_awkward_rows(spark, sf):
    rows = [(1, "x " * 80, "en", "a", 160), (1, "x " * 80, "en", "a", 160), (None, None, None, None, None), (2, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("hash", F.lit(0))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).count()
        assert stage(spark, docs.where("false"), sf).count() == 0
    assert corpus_pipeline.near_duplicates(spark, docs, sf).where("doc_id = 1").count() == 1


def test_a_text_of_its_own_survives_the_copy_that_shares_its_id(spark, sf):
    first, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, first), (2, first + " end"), (2, other), (3, first)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    assert (1, first) in left and (2, other) in left and all(i != 3 for i, _ in left)
