"""Every query that has SQL gives the rows that DuckDB gives; every other one runs."""

import datetime

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return "-"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return str(v.date())
    return str(v)


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, data, duck, name):
    found = catalog.queries()[name](spark, data).toPandas()
    if name in catalog.oracle_sql():
        truth = duck.execute(catalog.oracle_sql()[name]).df()
        assert sorted(found.columns) == sorted(truth.columns)
        assert rows(found) == rows(truth)
