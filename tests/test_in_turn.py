"""Groups that are folded as they come in Arrow batches."""

import random

from sightline.operators import sequences


def test_groups_longer_and_shorter_than_batches(spark):
    r = random.Random(3)
    sizes = [1, 2, 700, 1, 350, *(r.randint(1, 9) for _ in range(300))]
    rows = [(g if g else None, "ab"[g % 2], k, float(r.randint(0, 60)) if r.random() < 0.97 else 61.0) for g, n in enumerate(sizes) for k in range(n)]
    r.shuffle(rows)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = sequences.spaced(spark.createDataFrame(rows, "g int, s string, k int, y double"), ["g", "s"], ["k"], "y", 8).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want, last = set(), {}
    for g, s, k, y in sorted(rows, key=lambda x: (x[0] or 0, x[2])):
        ok = g not in last or y > last[g] + 8
        last[g] = y if ok else last[g]
        want.add((g, s, k, y, ok))
    assert {tuple(x) for x in got} == want and len(got) == len(rows)


def test_no_call_for_each_group(spark):
    df = sequences.spaced(spark.createDataFrame([(1, 1, 1.0)], "g int, k int, y double"), ["g"], ["k"], "y", 8)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
