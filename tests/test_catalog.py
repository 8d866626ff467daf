"""Every registered query of the model against its portable SQL twin."""

import os

import duckdb
import pytest

from deeptime import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def other():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name[:-8]} as select * from read_parquet('{SF}/{name}')")
    return con


def shown(v):
    if v is None or v != v:
        return ""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(name, spark, other):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    result = other.sql(catalog.oracle_sql()[name])
    assert sorted(result.columns) == columns
    want = sorted(tuple(shown(r[result.columns.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(name, spark):
    assert catalog.queries()[name](spark, SF).count() > 0
