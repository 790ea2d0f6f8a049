"""Texts within a few edits, and the nearest ones, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.functions import names
from sightline.operators import likely, nearest


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[-1] + 1, old[j + 1] + 1, old[j] + (x != y)))
    return row[-1]


def plain(a, b):
    n = max(len(a), len(b))
    return 100 if n == 0 else 100 * (n - lev(a, b)) // n


def sides(spark, r, n=60, letters="ab0o1l", longest=9):
    word = lambda: "".join(r.choices(letters, k=r.randrange(longest + 1)))
    x, y = ([(k % 2, word()) for k in range(n)] for _ in range(2))
    return x, y, spark.createDataFrame([*x, (0, None)], "block int, x string"), spark.createDataFrame([*y, (1, None)], "block int, y string")


@pytest.mark.parametrize("edits", [1, 2])
def test_within(spark, edits):
    x, y, left, right = sides(spark, random.Random(edits))
    got = {tuple(t) for t in nearest.within(nearest.as_written(left, ["block"], "x"), nearest.as_written(right, ["block"], "y"), ["block"], "x", "y", edits).collect()}
    assert got == {(b, s, t) for b, s in x for c, t in y if b == c and lev(s, t) <= edits}


@pytest.mark.parametrize("least", [30, 85])
def test_reaching(spark, least):
    x, y, left, right = sides(spark, random.Random(least), longest=14, letters="ab")
    got = {tuple(t) for t in nearest.reaching(left, right, ["block"], "x", "y", least).collect()}
    assert got == {(b, s, t, plain(s, t)) for b, s in x for c, t in y if b == c and plain(s, t) >= least}


@pytest.mark.parametrize(("least", "weighted"), [(0, False), (60, True)])
def test_nearest(spark, least, weighted):
    x, y, left, right = sides(spark, random.Random(least + weighted), letters="ab0o1lcde" if least else "abcdefgh0o1l")
    how = (names.likeness, likely.forms) if weighted else (names.edit_ratio, nearest.as_written)
    score = names.token_set_ratio if weighted else plain
    want = set()
    for b, s in set(x):
        each = {t: score(s, t) for c, t in y if b == c}
        want |= {(b, s, t, v) for t, v in each.items() if v == max(each.values()) >= least}
    got = [tuple(t) for t in nearest.nearest(left, right, ["block"], "x", "y", *how, least=least).collect()]
    assert set(got) == want and len(got) == len(want)


def test_names_of_one_beginning_are_not_all_compared(spark):
    """2,000 numbered names in one block: 4 million pairs, of which the pieces of long shared beginnings leave nearly all."""
    s = spark.range(2000).select(F.lit(1).alias("block"), F.format_string("Supplier#%09d", "id").alias("y"))
    near = nearest.within(likely.forms(s.withColumn("x", F.translate("y", "01", "Oi")), ["block"], "x"), likely.forms(s, ["block"], "y"), ["block"], "x", "y", 1)
    assert 2000 <= near.count() < 500_000
    best = nearest.nearest(s.select("block", F.translate("y", "01", "Oi").alias("x")), s, ["block"], "x", "y", names.likeness, likely.forms)
    assert best.where(F.translate("y", "01", "Oi") == F.col("x")).count() == 2000 == best.count()


def test_closest(spark):
    r = random.Random(4)
    rows = [(g, i, "".join(r.choices(["abcdefghij", "01"][g % 2], k=r.randrange(1, 9)))) for g in range(4) for i in range(25)] + [(7, 1, "abc"), (7, 2, "xyz"), (7, 3, "x"), (8, 1, "alone"), (9, 5, "twin"), (9, 3, "twin"), (9, 4, "twin")]
    got = {tuple(t) for t in nearest.closest(spark.createDataFrame(rows, "g int, i int, name string"), ["g"], "name", "i").collect()}
    want = set()
    for g in {x[0] for x in rows}:
        pairs = [(-plain(s, t), i, j) for h, i, s in rows for k, j, t in rows if h == k == g and i < j]
        if pairs:
            score, a, b = min(pairs)
            want.add((g, a, b, -score))
    assert got == want
