import random

import numpy as np
import pytest

from sightline.functions import names
from sightline.operators import claims, nearest, resolve
from tests.test_nearest import plain as nearest_plain

MEMBERS = "g int, row int, member int, score int"


def test_equals_single_claims_on_random_matrices(spark):
    """A hundred captures at once, many ties and near ties, against the sequential claims."""
    r = random.Random(9)
    want, rows = set(), []
    for g in range(100):
        n, m = r.randint(1, 9), r.randint(1, 7)
        choice = (0, 45, 55, 61, 70, 75, 80, 85, 90, 92, 93, 96, 98, 99, 100) if g % 2 else (70, 75, 78, 80, 92, 95)
        scores = np.array([[r.choice(choice) for _ in range(m)] for _ in range(n)])
        rows += [(g, i, j, int(scores[i, j])) for i in range(n) for j in range(m) if scores[i, j] or j == 0 or i == 0]
        member, score, phase = resolve.assign(scores)
        want |= {(g, i, int(member[i]), int(score[i]), int(phase[i])) for i in range(n)}
    got = {tuple(x) for x in claims.assignments(spark.createDataFrame(rows, MEMBERS), "g").select("g", "row", "member", "score", "phase").collect()}
    assert got == want


def test_an_early_claim_does_not_free_a_contested_member(spark):
    """Row 2 would beat row 0 for member 0 once member 1 is gone, but single claims give member 0 away before."""
    scores = np.array([[78, 0, 40], [0, 75, 50], [80, 70, 0]])
    rows = [(1, i, j, int(scores[i, j])) for i in range(3) for j in range(3)]
    got = {x.row: (x.member, x.score, x.phase) for x in claims.assignments(spark.createDataFrame(rows, MEMBERS), "g").collect()}
    member, score, phase = resolve.assign(scores)
    assert got == {i: (member[i], score[i], phase[i]) for i in range(3)} and got[0] == (0, 78, 2)


def test_empty_and_unfit(spark):
    assert claims.assignments(spark.createDataFrame([], MEMBERS), "g").count() == 0
    assert [tuple(x) for x in claims.assignments(spark.createDataFrame([(1, 1, 1, 30)], MEMBERS), "g").collect()] == [(1, 1, -1, 0, 0)]
    with pytest.raises(ValueError, match="floor"):
        claims.assignments(spark.createDataFrame([], MEMBERS), "g", margin=0)


def test_rounds_equal_single_claims(spark):
    """Groups too large for a task: the same, also where a claim frees a row for a member that a row freed by a later claim would score better."""
    scores = np.array([[91, 0, 0], [75, 88, 0], [0, 0, 85], [0, 90, 80]])
    rows = [(1, i, j, int(scores[i, j])) for i in range(4) for j in range(3)]
    r, want = random.Random(10), set()
    for g in range(2, 40):
        m = np.array([[r.choice((0, 61, 70, 75, 78, 80, 85, 88, 90, 92, 95, 100)) for _ in range(5)] for _ in range(r.randint(1, 9))])
        rows += [(g, i, j, int(m[i, j])) for i in range(len(m)) for j in range(5)]
        want |= {(g, i, *map(int, x)) for i, x in enumerate(zip(*resolve.assign(m), strict=True))}
    got = {tuple(x) for x in claims.assignments(spark.createDataFrame(rows, MEMBERS), "g", most=0).collect()}
    assert {x for x in got if x[0] == 1} == {(1, 0, 0, 91, 2), (1, 1, 1, 88, 2), (1, 2, 2, 85, 2), (1, 3, -1, 0, 0)}
    assert {x for x in got if x[0] > 1} == want


def test_names_equal_all_pairs(spark):
    """Claims of names by their few edits against the whole matrix, with ties, rows of two texts, rows without text and parameters that leave no score out."""
    r, rows, members, cells = random.Random(11), [], [], []
    for g in range(12):
        own = [(g, 50 + k, "".join(r.choices("abcde", k=r.randint(3, 14)))) for k in range(r.randint(1, 7))]
        own += [(g, 90, own[0][2])] if g % 3 == 0 else []
        texts = [(g, i, r.choice([None, "".join(r.choices("abcde", k=5)), *[x[2] for x in own] * 2, own[0][2][:-1] + "x"])) for i in range(r.randint(1, 9)) for _ in range(r.choice((1, 1, 2)))]
        rows, members = rows + texts, members + own
        for i in {t[1] for t in texts}:
            for _, m, name in own:
                cells.append((g, i, m, max(0 if t is None else nearest_plain(t, name) for _, k, t in texts if k == i)))
    x, y = spark.createDataFrame(rows, "g int, row int, text string"), spark.createDataFrame(members, "g int, member int, name string")
    for floor, margin in ((60, 20), (40, 50)):
        got = {tuple(t) for t in claims.named(x, y, "g", "text", "name", names.edit_ratio, nearest.as_written, floor, margin).collect()}
        assert got == {tuple(t) for t in resolve.assignments(spark.createDataFrame(cells, MEMBERS), "g", floor, margin).collect()}
