"""Every catalogue query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest
from cadenza import inspection_queries  # noqa: F401  adds its queries
from cadenza.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(names, values):
    at = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return Counter(tuple(text(v[i]) for i in at) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, name):
    got = QUERIES[name](spark, DATA)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["q_timeline_verify", "q_preflight", "q_project_inspect"])
def test_cameras_are_joined_once(spark, name):
    """What all branches of a query read is written first, so none of them joins line items to orders anew."""
    assert "l_orderkey" not in QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_streams_come_with_their_rows(spark):
    plan = QUERIES["q_stream_rules"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_discount" in plan and "Join Inner, (((take_id" not in plan and plan.count("Join") <= 8


def test_timeline_tables_are_dealt_by_session_once(spark):
    """What belongs to a session meets by windows after one shuffle: items, links and takes are not joined one after the other."""
    plan = QUERIES["q_timeline_verify"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 8 and "Join LeftSemi" not in plan
