"""The operators whose results SQL can state, against DuckDB."""

import duckdb
import pytest

from corpusloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*expected.columns)
    assert sorted(map(tuple, got.collect())) == sorted(expected.fetchall())
