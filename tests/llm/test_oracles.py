"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from voxelith.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in got.select(*columns).collect()) == order(want.select(*columns).fetchall())
