"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from faultloom.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.oracle_sql())
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if v is None or (isinstance(v, float) and pd.isna(v)) or v is pd.NA else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row) for row in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    expected = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    num = lambda df: df.apply(lambda c: c.astype(float) if c.dtype.kind in "iuf" or str(c.dtype) in ("Int64", "Int32") else c)
    assert _rows(num(got)) == _rows(num(expected))


def test_entry_without_training_data_operators():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
