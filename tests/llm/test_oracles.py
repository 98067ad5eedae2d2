"""The operators that SQL can express agree with their SQL over whole tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from melodex.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ran = duck.execute(registry.ORACLE[name])
    at = [x[0] for x in ran.description]
    assert sorted(at) == columns
    want = [tuple(r[at.index(c)] for c in columns) for r in ran.fetchall()]
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want, key=str)
