"""The operators that SQL can express, against their SQL."""

import duckdb
import pytest

from skyledger.llm import queries
from tests.test_queries import TABLES


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf)
    types = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    assert {n: types[t] for n, t in got.dtypes} == {n: str(t) for n, t in zip(want.columns, want.types, strict=True)}
    def plain(row):
        return repr([round(float(x), 9) if isinstance(x, int | float) else x for x in row])

    assert sorted(map(plain, got.collect())) == sorted(map(plain, want.fetchall()))
