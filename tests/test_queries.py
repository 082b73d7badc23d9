"""Every registered query against its DuckDB equivalent on the smallest tables."""

import math

import duckdb
import pytest

from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return str(v) if v is not None and not isinstance(v, (int, str)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    data = got.collect()
    if name in ORACLES:
        expected = duck.sql(ORACLES[name])
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got.columns, data) == rows(expected.columns, expected.fetchall())
    else:
        assert len(data) > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
