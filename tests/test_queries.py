"""Every registered query of the melodic operators runs, and agrees with its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from melodex import queries as Q

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    assert got
    if name in Q.ORACLE:
        ran = duck.execute(Q.ORACLE[name])
        at = [x[0] for x in ran.description]
        assert sorted(at) == columns
        assert sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in ran.fetchall()), key=str) == got


def test_flagship_is_registered():
    assert Q.FLAGSHIP in Q.ORACLE
