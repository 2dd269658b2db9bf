"""Every registered query against its DuckDB text."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_module

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(df.columns):
        x = df[c]
        if pd.api.types.is_bool_dtype(x) or pd.api.types.is_numeric_dtype(x):
            out[c] = x.astype(float).round(6) + 0.0
        else:
            out[c] = x.astype(str)
    frame = pd.DataFrame(out)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) > 0
    if name not in ORACLES:
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        if a[c].dtype == float:
            np.testing.assert_allclose(a[c], b[c], rtol=1e-9, atol=2e-6, err_msg=c)
        else:
            assert (a[c] == b[c]).all(), c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert os.path.exists("/root/testdata/sf0.001")
    assert entry_module.entry(spark).count() > 0
