import math
import re

import numpy as np
from pyspark.sql import functions as F

from sightline.llm import toxicity
from tests.conftest import SF01
from tests.llm.cases import awkward, docs


def test_ordinal_fit_recovers_order():
    r = np.random.default_rng(3)
    x = r.random((4000, 6)) < 0.4
    w = np.array([2.0, 1.0, 0.0, -1.0, 3.0, 0.5])
    s = x @ w + r.logistic(size=4000)
    grades = np.searchsorted([1.0, 3.0, 5.0], s)
    rows, cols = np.nonzero(x)
    weights, cuts = toxicity.fit_ordinal(rows, cols, grades, 6)
    assert np.all(np.diff(cuts) > 0)
    assert np.abs(weights - w).max() < 0.35 and np.abs(cuts - [1, 3, 5]).max() < 0.35


def test_held_out_accuracy(spark):
    """Fitted on a half of the labels by hash, some 220 toxic documents; the other half tells how well it does."""
    sf = "/root/testdata/sf0.1"
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    model = toxicity.fit(df, labels.where(half == 0))
    rest = labels.where(half == 1).withColumnRenamed("toxic", "truth")
    got = toxicity.severities(df, labels, model=model).join(rest, "doc_id").toPandas()
    hit, false = got[got.truth == 1].toxic.mean(), got[got.truth == 0].toxic.mean()
    assert len(got) > 1500 and hit > 0.8 and false < 0.005, (hit, false)
    assert (got.grade > 0).eq(got.toxic).all()


def test_scores_against_plain_python(spark):
    """Every row's severity, recomputed from the model's weights without the operator's memo or batches."""
    df, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    model = toxicity.fit(df, labels)
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in toxicity.severities(df, labels, model=model).collect():
        words = set(re.findall(r"[^\W\d_]+", texts[r.doc_id].lower()))
        score = sum(model.weights.get(f, 0.0) for f in {f for w in words for f in toxicity.word_features(w)})
        above = [1 / (1 + math.exp(c - score)) for c in model.cuts]
        assert abs(r.score - score) < 1e-4 and abs(r.expected_severity - sum(above)) < 1e-3
        assert r.toxic == (above[0] >= 0.5) and r.grade == sum(a >= 0.5 for a in above)


def test_filter_agrees_and_takes_awkward_rows(spark):
    df, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    model = toxicity.fit(df, labels)
    kept = toxicity.clean_documents(df, labels, model=model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in toxicity.severities(df, labels, model=model).collect() if not r.toxic}
    got = toxicity.severities(docs(spark), labels, model=model).collect()
    assert len(got) == len(awkward()) and all(0 <= r.expected_severity <= 3 for r in got)
    assert got[0].score == 0
    assert toxicity.severities(docs(spark, []), labels).count() == 0
    assert toxicity.clean_documents(docs(spark), labels.limit(0)).count() == len(awkward())


def test_given_grades(spark):
    rows = [(i, "bad " * (i % 4 > 0) + "worse " * (i % 4 > 1) + "worst " * (i % 4 > 2) + "fine", "en", "s", 1) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 4) for i in range(400)], "doc_id long, grade int")
    got = toxicity.severities(df, labels).collect()
    assert all(r.grade == r.doc_id % 4 for r in got)


def test_fitted_rows_are_bounded_also_where_a_doc_id_repeats(spark, monkeypatch):
    seen = []
    real = toxicity.fit_ordinal
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda rows, cols, grades, *a: seen.append(grades) or real(rows, cols, grades, *a))
    rows = [(i % 5, f"{'bad' if i % 5 == 0 else 'good'} word number{i % 40}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 0)) for i in range(5)], "doc_id long, toxic int")
    models = [toxicity.fit(df.repartition(n), labels, fit_rows=450) for n in (3, 7)]
    assert [len(x) for x in seen] == [450, 450] and (seen[0] == seen[1]).all()
    assert models[0] == models[1] and models[0].weights
