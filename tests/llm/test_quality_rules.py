import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sightline.llm import quality_rules
from tests.conftest import SF01
from tests.llm.cases import DOC_SCHEMA, docs, words


def brute(text):
    own = words(text)
    five = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
    often = Counter(five)
    repeated = {i + k for i, w in enumerate(five) if often[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_counts_of_awkward_rows(spark):
    df = docs(spark)
    got = quality_rules.verdicts(df, labels(spark, [])).collect()
    want = sorted((r.doc_id, *brute(r.text)) for r in df.collect())
    assert sorted((r.doc_id, *(r[c] for c in COLUMNS)) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed) and r.rule == 0 for r in got)
    assert quality_rules.verdicts(spark.createDataFrame([], DOC_SCHEMA), labels(spark, [])).count() == 0


def test_counts_of_random_texts(monkeypatch):
    monkeypatch.setattr(quality_rules, "SLICE", 50)
    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "b ", "é", "\n", " \x0b", "#x", "a b c d e ", "\t", "日本 ", "B!"], k=rng.randrange(40))) for _ in range(300)]
    got = [tuple(int(found[c][k]) for c in COLUMNS) for lo, hi, found in quality_rules.measure(pa.array(texts)) for k in range(hi - lo)]
    assert got == [brute(t) for t in texts]


def test_learned_conjunction():
    """A class that needs two conditions is found as a rule of two, by bounds within the gap that parts it from the others."""
    rng = np.random.default_rng(2)
    x = np.zeros((3000, len(quality_rules.RATES)))
    names = list(quality_rules.RATES)
    symbols, upper = names.index("symbols_per_word"), names.index("upper_share")
    x[:, symbols], x[:, upper] = rng.integers(0, 2, 3000) * 0.8, rng.integers(0, 2, 3000) * 0.9
    bad = (x[:, symbols] > 0.5) & (x[:, upper] < 0.5)
    rules = quality_rules.learn(x, bad, rng.integers(0, 3, 3000) == 0)
    assert len(rules) == 1 and {(r, lower) for r, lower, _ in rules[0].conditions} == {("symbols_per_word", True), ("upper_share", False)}
    assert rules[0].good == 0 and rules[0].bad == bad.sum()


def test_noise_gives_no_rule():
    rng = np.random.default_rng(4)
    assert quality_rules.learn(rng.random((2000, len(quality_rules.RATES))), rng.random(2000) < 0.1, rng.integers(0, 3, 2000) == 0) == []


def test_order_of_rules(spark):
    rules = [quality_rules.Rule((("symbols_per_word", True, 0.5),)), quality_rules.Rule((("n_words", True, 12.0), ("upper_share", False, 0.1)))]
    texts = ["w# " * 6 + "a b c d e f", "a b c d e f g h i j k l m", "A B C D E F G H I J K L M", "x"]
    df = docs(spark, [(i, t, *[None] * 9) for i, t in enumerate(texts)])
    got = {r.doc_id: (r.rule, r.kept) for r in quality_rules.verdicts(df, labels(spark, []), rules).collect()}
    assert got == {0: (1, False), 1: (2, False), 2: (0, True), 3: (0, False)}


def test_fit_is_bounded_by_rows_and_ignores_odd_labels(spark):
    texts = [" ".join(f"word{k}{'#%' * (i % 2)}" for k in range(20)) for i in range(60)]
    df = docs(spark, [(i % 10 if i % 2 else i, t, *[None] * 9) for i, t in enumerate(texts)])  # half of the rows share five ids
    some = [(i, 1) for i in range(0, 60, 2)] + [(i, 0) for i in range(1, 10, 2)] + [(7, 1), (None, 0), (2, None), (999, 0)]
    stats = quality_rules.statistics(df)
    rules = quality_rules.fit(stats, labels(spark, some))
    assert [r.good for r in rules] == [0] and rules[0].bad == 30
    assert quality_rules.fit(stats, labels(spark, some), fit_rows=4) == []
    assert quality_rules.fit(stats, labels(spark, [(7, 0)])) == [] == quality_rules.fit(stats, labels(spark, []))


def test_held_out_labels(spark):
    """Fitted on half of the labels of sf0.1, the list rejects the junk of the other half and keeps its clean documents."""
    df = spark.read.parquet(f"{SF01.replace('0.01', '0.1')}/documents.parquet")
    known = spark.read.parquet(f"{SF01.replace('0.01', '0.1')}/labels.parquet")
    half = "pmod(xxhash64(doc_id, 99), 2)"
    stats = quality_rules.statistics(df.join(known.select("doc_id"), "doc_id")).cache()
    rules = quality_rules.fit(stats, known.where(f"{half} = 0"))
    told = quality_rules.with_rates(stats).withColumn("gone", quality_rules.base_failed() | (quality_rules.first_rule(rules) > 0))
    got = {(r.quality, r.gone): r["count"] for r in told.join(known.where(f"{half} = 1"), "doc_id").groupBy("quality", "gone").count().collect()}
    assert got[0, True] >= 0.9 * (got[0, True] + got.get((0, False), 0))
    assert got.get((1, True), 0) <= 0.02 * (got[1, False] + got.get((1, True), 0))
