"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pytest

from foldmill.plans import catalogue, encodings

SF = "/root/testdata/sf0.001"
QUERIES, SQL = {**catalogue.QUERIES, **encodings.QUERIES}, {**catalogue.SQL, **encodings.SQL}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.removesuffix('.parquet')} as from '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    assert mine == sorted(map(str, duck.sql(f"select {', '.join(cols)} from ({SQL[name]})").fetchall()))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
