"""Every registered query with an oracle, against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from brindle.catalog import TABLES
from brindle.queries import registry

QUERIES, ORACLES = registry.load()


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    theirs = duck.sql(ORACLES[name])
    assert sorted(theirs.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    assert ours == sorted(tuple(cell(r[k]) for k in at) for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
