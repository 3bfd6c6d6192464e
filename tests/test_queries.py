"""Every query that has SQL, against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from trackmill.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(rows, columns):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(one(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, small, duck, name):
    ours = [r.asDict() for r in QUERIES[name](spark, small).collect()]
    theirs = duck.sql(ORACLES[name]).limit(10**9).fetchall()
    columns = duck.sql(ORACLES[name]).columns
    theirs = [dict(zip(columns, r)) for r in theirs]
    if ours:
        assert sorted(ours[0]) == sorted(columns)
    assert plain(ours, sorted(columns)) == plain(theirs, sorted(columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
