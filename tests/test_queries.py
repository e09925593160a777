"""Every query over the observation view against its SQL, and the regression numbers."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from skyledger.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame):
    plain = lambda x: None if pd.isna(x) else round(float(x), 9) if isinstance(x, float) else x.item() if hasattr(x, "item") else x
    return sorted(repr([plain(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    assert rows(got) == rows(duck.sql(registry.ORACLES[name]).df())


def test_regression_numbers(spark, sf):
    r = entry.entry(spark).first()
    assert (r["epochs"], r["maxobs"], r["maxsats"], r["satobs"], r["totobs"], r["maxepochs"]) == (531, 6, 6, 75, 994, 80)


def test_registration():
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and set(registry.QUERIES) <= set(found)
