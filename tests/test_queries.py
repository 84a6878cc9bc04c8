"""Every engine query against its SQL in DuckDB."""

from __future__ import annotations

import os

import pytest

from quillon.plans import queries as q

DATA = "/root/testdata/sf0.001"
TABLES = "customer events lineitem orders pages part".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    found = duck.execute(q.SQL[name])
    have = [d[0] for d in found.description]
    assert sorted(have) == names
    at = [have.index(n) for n in names]
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(clean(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(clean(r[n]) for n in names) for r in df.collect()), key=repr) == want


def test_flagship_is_sorted_and_shuffles_once_for_the_count(spark):
    df = q.threshold_codes(spark, DATA)
    rows = [r["code"] for r in df.collect()]
    assert rows == sorted(rows) and rows
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1


def test_bodies_are_made_of_rows_dealt_over_tasks(spark):
    plan = q.QUERIES["order_body_check"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("RepartitionByExpression") < plan.index("parquet")
