import random
import re
from collections import Counter

from sightline.llm import divergence
from tests.llm.cases import DOC_SCHEMA, docs

LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support=3, top=200):
    rows = [((lang or "", source or ""), LETTERS.findall((text or "").translate(LOW))) for lang, source, text in rows]
    out = set()
    for lang in {g[0] for g, _ in rows}:
        own = [(g, t) for g, t in rows if g[0] == lang]
        seen = Counter(x for _, t in own for x in set(t))
        kept = sorted(x for x, n in seen.items() if n >= support)
        count = {g: Counter() for g, _ in own} | {None: Counter()}
        for g, t in own:
            for x in t:
                if seen[x] >= support:
                    count[g][x] += 1
                    count[None][x] += 1
        share = {g: {x: 1 + 1000000000 * (c[x] + 1) // (sum(c.values()) + len(kept)) for x in kept} for g, c in count.items()}
        f = lambda p, q: (p - q) * (p - q) // q
        for g in count:
            if g is not None:
                pairs = sorted((-sum(f(share[g][x], share[h][x]) for x in kept), h[1].encode(), h[1]) for h in count if h not in (None, g))
                terms = sorted((-f(share[g][x], share[None][x]), x.encode(), x) for x in kept if count[g][x] and share[g][x] > share[None][x])[:top]
                out |= {(*g, part, item, -v, k) for part, some in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(some, 1)}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(spark, rows):
    return docs(spark, [(i, text, lang, source, None, None, None, None, None, None, None) for i, (lang, source, text) in enumerate(rows)])


def test_random_groups(spark, monkeypatch):
    rng = random.Random(5)
    pool = [f"{a}{b}" for a in "abcdéß日" for b in "xyzÀ"]
    for case in range(3):
        rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", "é", None, "s" * (case + 1)]), None if rng.random() < 0.1 else " ".join(rng.choices(pool, k=rng.randrange(0, 30))).replace("ax", "AX") + "12! _") for _ in range(90)]
        assert found(divergence.source_divergence(made(spark, rows))) == brute(rows)


def test_many_groups_and_blocks(spark, monkeypatch):
    """Blocks of three terms and passes of two rounds give what one block and one pass give; odd and even numbers of groups."""
    rng = random.Random(6)
    rows = [("en", f"s{rng.randrange(9)}", " ".join(rng.choices([f"w{chr(97 + k)}" for k in range(26)], k=12))) for _ in range(60)] + [("fr", f"s{k}", "un deux trois") for k in range(4)]
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "ROUNDS", 2)
    assert found(divergence.source_divergence(made(spark, rows), top=5)) == brute(rows, top=5)


def test_rounds_meet_everyone_once(spark):
    for n in (2, 3, 8, 9):
        grid = spark.range(n).selectExpr("cast(id as int) g").crossJoin(spark.range(n + n % 2 - 1).selectExpr("cast(id as int) r"))
        met = [tuple(x) for x in grid.selectExpr("r", "g", f"cast({divergence.opponent('g', str(n), 'r')} as int)").collect()]
        assert {(r, h, g) for r, g, h in met if h < n} == {x for x in met if x[2] < n}
        assert sorted((g, h) for _, g, h in met if h < n) == [(g, h) for g in range(n) for h in range(n) if g != h]


def test_awkward_rows(spark):
    df = docs(spark)
    rows = [(r.lang, r.source, r.text) for r in df.collect()]
    assert found(divergence.source_divergence(df)) == brute(rows)
    assert found(divergence.source_divergence(made(spark, [("en", "a", None), ("en", "b", "x"), (None, None, "")]))) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert divergence.source_divergence(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_terms_across_slices(spark, monkeypatch):
    text = "ab cde " * 40 + "ABC-é"
    monkeypatch.setattr(divergence, "SLICE", 7)
    got = [t for part in divergence._terms(text.encode()) for t in part]
    assert [t.decode() for t in got] == LETTERS.findall(text.translate(LOW))
