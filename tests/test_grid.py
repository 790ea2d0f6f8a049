import random
from collections import Counter

from sightline.functions import names
from sightline.operators import nearest, probes
from tests.test_nearest import plain
from tests.test_operators import claims


def test_grid_equals_single_claims_and_plain_thresholds(spark):
    r = random.Random(6)
    pairs, truth, want = [], [], {}
    for g in range(8):
        n, m = r.randint(1, 6), r.randint(1, 5)
        scores = [[r.choice((0, 55, 61, 70, 85, 92, 95, 100)) for _ in range(m)] for _ in range(n)]
        right = [r.randrange(-1, m) for _ in range(n)]
        pairs += [(g, i, j, scores[i][j]) for i in range(n) for j in range(m)]
        truth += [(g, i, right[i]) for i in range(n) if right[i] >= 0]
        for floor in (60, 80):
            for margin in (-1, 1, 20):
                got = claims(scores, floor, margin) if margin > 0 else [(s.index(max(s)) if max(s) >= floor else -1, 0, 0) for s in scores]
                c = want.setdefault((floor, margin), Counter())
                for (member, _, phase), t in zip(got, right, strict=True):
                    c["duplicate" if phase == 3 else "unassigned" if member < 0 else "correct" if member == t else "wrong"] += 1
    df = probes.grid(spark.createDataFrame(pairs, "g int, row int, member int, score int"), spark.createDataFrame(truth, "g int, row int, member int"), "g", [60, 80], [1, 20])
    got = {(x.floor, x.margin): (x.correct, x.wrong, x.unassigned, x.duplicate) for x in df.collect()}
    assert got == {k: tuple(c[x] for x in ("correct", "wrong", "unassigned", "duplicate")) for k, c in want.items()}


def test_grid_of_names_equals_that_of_all_pairs(spark):
    r, rows, members, pairs, truth = random.Random(8), [], [], [], []
    for g in range(5):
        own = [(g, k, "".join(r.choices("abc", k=5))) for k in range(r.randint(2, 6))]
        mine = [(g, 10 + i, r.choice([own[i % len(own)][2], own[0][2], "".join(r.choices("abcd", k=5)), "~~~"])) for i in range(r.randint(2, 7))]
        rows, members = rows + mine, members + own
        truth += [(g, i, own[i % len(own)][1]) for _, i, _ in mine if i % 4]
        pairs += [(g, i, m, plain(t, n)) for _, i, t in mine for _, m, n in own]
    kind = "g int, row int, member int"
    x, y, t = spark.createDataFrame(rows, "g int, row int, text string"), spark.createDataFrame(members, "g int, member int, name string"), spark.createDataFrame(truth, kind)
    got = probes.grid_of_names(x, y, t, "g", "text", "name", names.edit_ratio, nearest.as_written, [40, 60, 92], [1, 30])
    want = probes.grid(spark.createDataFrame(pairs, f"{kind}, score int"), t, "g", [40, 60, 92], [1, 30])
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in want.collect()}
