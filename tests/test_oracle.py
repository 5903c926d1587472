"""Every registered query against its DuckDB oracle on the smoke tables (sf0.001)."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from quillspark.sources.tables import TABLES

from .conftest import SMOKE_DIR

SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["x", "y"]
    assert df.count() >= 0


def test_every_key_has_a_callable():
    assert set(SQL) <= set(queries())


@pytest.mark.parametrize("key", sorted(SQL))
def test_against_oracle(spark, duck, key):
    sdf = queries()[key](spark, SMOKE_DIR)
    cols = sorted(sdf.columns)
    a = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    res = duck.execute(SQL[key])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    b = sorted((tuple(_norm(dict(zip(names, r))[c]) for c in cols) for r in res.fetchall()), key=repr)
    assert a == b
