"""Every query runs; those with SQL give what DuckDB gives."""

import glob
import os

import duckdb
import pytest

from voxelith import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert got
    if sql := queries.oracle_sql().get(name):
        want = con.sql(sql)
        assert sorted(want.columns) == columns
        order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, 0 if x is None else x) for x in r))
        assert order(got) == order(want.select(*columns).fetchall())


def test_flagship(spark):
    assert queries.flagship(spark, "/root/testdata/sf0.001").count() > 0
