"""Plans that hold when tables grow: rows that are many for each row of a table aren't broadcast, and what is met is what is told."""

import pytest

from sightline.operators import evaluate, nearest
from sightline.plans import registry
from tests.conftest import SF


@pytest.mark.parametrize("name", ["j_ovl_rectangles", "s_man_manifest_faults", "j_ovl_overlaps"])
def test_exploded_rows_are_not_broadcast(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_united_scores_make_each_pair_once(spark):
    """Without an aggregate over the pairs, if rows and members are in one block each; with one, if not."""
    reads = spark.createDataFrame([(0, 1, "abc"), (0, 1, "abd"), (0, 2, ""), (1, 3, "x")], "b int, row int, text string")
    members = spark.createDataFrame([(0, 10, "abd"), (0, 11, "zzz"), (1, 12, "xy")], "b int, member_id int, name string")
    once = evaluate.united_scores(reads, members, ["b"], "row", "text", "member_id", "name")
    assert {tuple(r) for r in once.collect()} == {(1, 10, 100), (1, 11, 0), (2, 10, 0), (2, 11, 0), (3, 12, 50)}
    assert once._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    again = evaluate.united_scores(reads.union(spark.createDataFrame([(1, 1, "xy")], reads.schema)), members.union(spark.createDataFrame([(1, 10, "xy")], members.schema)), ["b"], "row", "text", "member_id", "name")
    assert {tuple(r) for r in again.collect() if r.row == 1} == {(1, 10, 100), (1, 11, 0), (1, 12, 100)}


@pytest.mark.parametrize("name", ["a_mem_creatable_members", "a_nam_name_probe", "a_uni_best_texts", "a_agr_agreement"])
def test_best_reads_are_not_sought_among_all_pairs(spark, name, monkeypatch):
    asked = []
    one = nearest.nearest
    monkeypatch.setattr(nearest, "nearest", lambda *a, **b: asked.append(1) or one(*a, **b))
    assert registry.QUERIES[name](spark, SF).count() and asked
