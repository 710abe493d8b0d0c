"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from stie.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def aligned(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if pd.api.types.is_numeric_dtype(out[c]) and not pd.api.types.is_bool_dtype(out[c]):
            out[c] = out[c].astype("float64").round(6)
        else:
            out[c] = out[c].map(lambda v: "" if v is None or v is pd.NA or v != v else str(v))
    return out.sort_values(list(out.columns), kind="stable").reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, sf, duck, name):
    got, expected = aligned(catalogue.QUERIES[name](spark, sf).toPandas()), aligned(duck.sql(catalogue.ORACLES[name]).df())
    assert list(got.columns) == list(expected.columns)
    assert len(got) == len(expected)
    for c in got.columns:
        if got[c].dtype == np.float64:
            np.testing.assert_allclose(got[c], expected[c], atol=2e-6, equal_nan=True, err_msg=c)
        else:
            assert got[c].tolist() == expected[c].tolist(), c


#: Beyond SQL, with the tests that hold them against known or brute-force results.
OTHERS = {
    "matched_events": "test_whole_job", "event_kpis": "test_whole_job", "kpi_by_type": "test_whole_job", "confusion": "test_whole_job", "boundary_errors": "test_whole_job", "metric_grid": "test_operators",
    "assembled_events": "test_operators", "linked_tracks": "test_tracking", "candidate_head": "test_operators", "verification_run": "test_runs",
}


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_others_give_rows_and_the_same_again(spark, sf, name):
    first, second = (aligned(catalogue.QUERIES[name](spark, sf).toPandas()) for _ in range(2))
    assert len(first) and first.equals(second)


def test_all_others_are_tested():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == set(OTHERS)


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
