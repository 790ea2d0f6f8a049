import glob
import os

import duckdb
import pytest

from sightline.plans import registry
from tests.conftest import SF

import __spark_entry__ as entry_file


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    return round(float(v), 9) + 0.0 if hasattr(v, "__float__") and not isinstance(v, (int, bool)) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    c = duck.execute(registry.SQL[name])
    cols = [x[0] for x in c.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr(tuple(plain(r[cols.index(x)]) for x in sorted(cols))) for r in c.fetchall())
    assert sorted(repr(tuple(plain(r[x]) for x in sorted(cols))) for r in df.collect()) == want


def test_entry_and_registry(spark):
    assert entry_file.entry(spark).count() > 0
    assert set(entry_file.oracle_sql()) <= set(entry_file.queries())


def test_plans_prune_and_avoid_cross_joins(spark):
    plan = registry.QUERIES["live_leaderboard"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    plan = registry.QUERIES["j_own_chain"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(r_name" in plan or "In(r_name, [ASIA,EUROPE])" in plan
