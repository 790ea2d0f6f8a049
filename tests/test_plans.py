"""What the plans of the core operators look like, and results where groups are large."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sightline.operators import facts, metrics
from sightline.plans import registry
from tests.conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_upsert_hashes(spark):
    text = plan(registry.QUERIES["o_ups_confidence_upsert"](spark, SF))
    assert "SortAggregate" not in text and text.count("HashAggregate") == 2 and text.count("Exchange") == 1


def test_no_cross_joins_but_with_single_rows(spark):
    for name in ("live_leaderboard", "j_own_chain", "j_plan_due_work", "j_ovl_overlaps", "j_ovl_rectangles", "w_peak_decoys", "j_cov_coverage", "m_pwr_growth"):
        text = plan(registry.QUERIES[name](spark, SF))
        assert "Cartesian" not in text and "NestedLoop" not in text, name


def test_precedence_orders_readings(spark):
    rows = [(0.9, 5), (0.9, 3), (0.8999999, 1), (None, 0), (1.0, 9), (0.0, 2)]
    got = spark.createDataFrame(rows, "c float, a long").orderBy(F.desc(facts.precedence(F.col("c"), F.col("a")))).collect()
    assert [r.a for r in got] == [9, 3, 5, 1, 0, 2]


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.973, 1.0])
def test_quantiles_are_exact(spark, q):
    r = random.Random(5)
    rows = [("many", float(r.randrange(10**6))) for _ in range(20_000)] + [("ties", float(r.randrange(3))) for _ in range(5000)] + [("few", 2.0), ("few", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {x.g: x.quantile for x in metrics.quantile(df, ["g"], "v", q).collect()}
    want = dict(duckdb.sql(f"select g, quantile_cont(v::DOUBLE, {q}) from (select unnest({[a for a, b in rows if b is not None]}) as g, unnest({[b for a, b in rows if b is not None]}) as v) group by 1").fetchall())
    assert set(got) == {"many", "ties", "few", "none"} and got["none"] is None
    assert all(got[g] == pytest.approx(float(want[g])) for g in want)


def test_leaderboard_ranks_within_parts(spark):
    r = random.Random(6)
    rows = [(k % 3 % 2, r.choice((0.0, float(r.randrange(2000)))), k) for k in range(9000)]
    got = facts.leaderboard(spark.createDataFrame(rows, "g int, value double, member_id int"), ["g"]).collect()
    for g in (0, 1):
        want = [m for _, _, m in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))]
        assert [x.member_id for x in sorted((x for x in got if x.g == g), key=lambda x: x.rank)] == want
