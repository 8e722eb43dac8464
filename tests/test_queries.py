"""Every registered query of the library against DuckDB on the same tables."""

import math

import duckdb
import pandas as pd
import pytest

from slotline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def shown(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else f"{x:.9g}"
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(shown, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows_as_sql(name, spark, sf, duck):
    got = registry.QUERIES[name](spark, sf).toPandas()
    want = duck.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)
