"""The join of names alike against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.functions import names
from sightline.operators import likely

LETTERS = "abcdeo0il15s8b9g6tfz2uvé狂 "


def made(r, n):
    return ["".join(r.choices(LETTERS, k=r.randrange(0, 13))) for _ in range(n)]


def noisy(r, name):
    s = list(name)
    for _ in range(r.randrange(4)):
        k = r.randrange(len(s) + 1)
        s[k : k + r.randrange(2)] = r.choices(LETTERS, k=r.randrange(2))
    return "".join(s)


@pytest.mark.parametrize("least", [51, 60, 75, 92, 100])
def test_no_pair_is_missing(spark, least):
    r = random.Random(least)
    members = made(r, 120)
    reads = [noisy(r, r.choice(members)) for _ in range(120)] + made(r, 20)
    x = spark.createDataFrame([(i % 2, s) for i, s in enumerate(reads)] + [(0, None)], "block int, read string")
    y = spark.createDataFrame([(i % 2, i, s, members[i - 7 : i - 5] if i % 5 == 0 else None) for i, s in enumerate(members)], "block int, member_id int, name string, aliases array<string>")
    want = {}
    for b, s in {(i % 2, s) for i, s in enumerate(reads)}:
        for i, m in enumerate(members):
            if i % 2 == b:
                score = max(names.token_set_ratios([(s, n) for n in [m, *(members[i - 7 : i - 5] if i % 5 == 0 else [])]]))
                if score >= least:
                    want[b, s, i] = score
    got = {(t.block, t.read, t.member_id): t.score for t in likely.likely(x, y, ["block"], "read", "name", aliases="aliases", least=least).collect()}
    assert got == want and want


def test_pairs_grow_with_matches(spark):
    """Of 4,000 names and as many reads in one block, 16 million pairs, only some thousand are scored."""
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=10))
    own = [word() for _ in range(4000)]
    x = spark.createDataFrame([(1, s[:4] + "q" + s[5:]) for s in own], "block int, read string")
    y = spark.createDataFrame([(1, s) for s in own], "block int, name string")
    assert 4000 <= likely.paired(x, y, ["block"], "read", "name").count() < 12_000


def test_closest_names(spark):
    r = random.Random(2)
    rows = [(g, i, "".join(r.choices(["abcdefghij", "0123456789"][g % 2], k=r.randrange(1, 9)))) for g in range(5) for i in range(40)] + [(7, 1, "abc"), (7, 2, "xyz"), (7, 3, "x"), (8, 1, "alone")]
    got = {(t.g, t.a, t.b, t.score) for t in likely.closest_names(spark.createDataFrame(rows, "g int, i int, name string"), ["g"], "name", "i").collect()}
    want = set()
    for g in {x[0] for x in rows}:
        pairs = [(-names.token_set_ratio(s, t), i, j) for h, i, s in rows for k, j, t in rows if h == k == g and i < j]
        if pairs:
            score, a, b = min(pairs)
            want.add((g, a, b, -score))
    assert got == want


def test_low_bounds_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "block int, name string")
    with pytest.raises(ValueError, match="likeness"):
        likely.paired(df, df.select("block", F.col("name").alias("read")), ["block"], "name", "read", 50)
