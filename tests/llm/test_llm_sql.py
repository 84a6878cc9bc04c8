"""Every training-data query that has SQL against it in DuckDB."""

from __future__ import annotations

import os

import pytest

from quillon.llm import queries as q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "documents pages benchmark conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_llm_query(spark, duck, name):
    df = q.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    found = duck.execute(q.ORACLE_SQL[name])
    have = [d[0] for d in found.description]
    assert sorted(have) == names
    at = [have.index(n) for n in names]
    want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == want
