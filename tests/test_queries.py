"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from skycat.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    number = lambda v: float(v) if hasattr(v, "dtype") or isinstance(v, (int, float)) else str(v)
    return sorted((tuple(None if v is None or v is pd.NA or v != v else number(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_oracle(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    expected = con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got)
    assert rows(got) == rows(expected)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
