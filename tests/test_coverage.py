import random

from pyspark.sql import functions as F

from sightline.functions import names
from sightline.operators import evaluate


def test_nearest_truth_is_that_of_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abO0l1 ") for _ in range(rng.randint(1, 7)))
    truths = spark.createDataFrame([(k, word(), k % 3) for k in range(60)] + [(60, "", 0), (61, None, 0)], "truth_id int, real string, truth_group int")
    created = spark.createDataFrame([(word(),) for _ in range(60)] + [("",), (None,)], "name string")
    scored = created.where("name <> ''").distinct().crossJoin(truths.where("real <> ''")).withColumn("score", names.likeness("name", "real")).where("score >= 75").collect()
    want = {}
    for r in sorted(scored, key=lambda r: (r.score, -r.truth_id)):
        want[r["name"]] = (r.truth_id, r.score, r.truth_group)
    got = {r["name"]: (r.truth_id, r.score, r.truth_group) for r in evaluate.nearest_truth(created, truths, "name", "real").collect()}
    assert got == want and want


def test_verdicts(spark):
    created = spark.createDataFrame([(1, 0, "anna"), (2, 1, "anna"), (3, 1, "otto"), (4, 0, "none")], "created_id int, `group` int, name string")
    truths = spark.createDataFrame([(7, "anna", 0), (8, "otto", 0)], "truth_id int, real string, truth_group int")
    best = created.select("created_id", "name").join(evaluate.nearest_truth(created, truths, "name", "real"), "name").drop("name")
    got = evaluate.coverage(created.drop("name"), best)
    assert {r.created_id: r.verdict for r in got.select(F.col("created_id"), "verdict").collect()} == {1: "covered", 2: "split", 3: "wrong group", 4: "orphan"}
