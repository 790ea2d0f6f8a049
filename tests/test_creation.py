import random

from sightline.operators import creation, resolve

ROWS = "g int, ordinal int, name string, confidence double, expected int"
MEMBERS = "g int, member_id long, name string"


def test_equals_rows_taken_in_turn(spark):
    """Sixty groups of names that are alike in chains, with totals that run out, unknown totals, blanks and weak reads."""
    r = random.Random(12)
    rows, members, want = [], [], set()
    for g in range(60):
        base = ["".join(r.choices("abcdexyzuvw", k=8)) for _ in range(r.randint(1, 4))]

        def near(word, r=r):
            s = list(word)
            for _ in range(r.choice((0, 0, 1, 2, 3))):
                s[r.randrange(len(s))] = r.choice("abcdexyzuvw")
            return "".join(s)

        own = [(g, 10 + i, near(r.choice(base))) for i in range(r.randint(0, 4))]
        total = r.choice((None, 0, 1, 2, 3, 4, 6, 30))
        mine = []
        for i in range(r.randint(1, 14)):
            name = r.choice((None, "", "  ")) if r.random() < 0.08 else near(r.choice([*base, "".join(r.choices("abcdexyzuvw", k=8))]))
            mine.append((g, i * 2, name, r.choice((0.1, 0.39, 0.4, 0.9, 0.95)), total if i >= 1 or r.random() < 0.5 else None))
        rows += mine
        members += own
        known = [x[4] for x in mine if x[4] is not None]
        for ordinal, outcome, member in resolve.roster_rows([(o, n, c) for _, o, n, c, _ in mine], {m: n for _, m, n in own}, known[0] if known else None):
            want.add((g, ordinal, outcome, member))
    got = {tuple(x) for x in creation.decisions(spark.createDataFrame(rows, ROWS), spark.createDataFrame(members, MEMBERS), ["g"]).collect()}
    assert got == want
    assert {x[2] for x in want} == {"unreadable_name", "matched", "ambiguous_name_match", "low_confidence_name", "created", "no_confident_match_group_full", "no_confident_match_group_count_unknown"}


def test_nothing_to_decide(spark):
    assert creation.decisions(spark.createDataFrame([], ROWS), spark.createDataFrame([], MEMBERS), ["g"]).count() == 0
