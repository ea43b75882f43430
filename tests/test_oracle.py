"""Every query with SQL against DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from ledgerloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if type(v).__name__ in ("float", "float64", "Decimal"):
        return f"{float(v):.9g}"
    if type(v).__name__ in ("date", "datetime", "Timestamp"):
        return str(pd.Timestamp(v))
    if hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return str(v.tolist())
    return str(v)


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted("|".join(map(cell, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, duck, sf, name):
    got = rows(catalogue.QUERIES[name](spark, sf).toPandas())
    assert got == rows(duck.execute(catalogue.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf, name):
    got = catalogue.QUERIES[name](spark, sf)
    assert got.columns and got.collect()
