"""Registered queries against their SQL twins, on the smallest tables."""

import os

import duckdb
import pytest

from docloom.plans.queries import QUERIES
from docloom.plans.sql import SQL


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return db


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    out = duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})")
    assert sorted(out.columns) == columns
    assert got == sorted((tuple(map(plain, r)) for r in out.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_no_query_pairs_all_with_all(spark, sf):
    for name in ("fused_search", "knn_topk", "passage_hits", "lexical_fallback"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_entry_lists_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
