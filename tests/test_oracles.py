"""Every query with oracle SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import decimal
import math

import pytest

from ladderlens.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(smallest):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{smallest}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    return None if isinstance(x, float) and math.isnan(x) else x


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_duckdb(spark, duck, smallest, name):
    df = registry.QUERIES[name](spark, smallest)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(map(same, a, b)), (a, b)
