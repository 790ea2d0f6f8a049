import hashlib
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from sightline.llm import merkle
from tests.conftest import SF
from tests.llm.cases import awkward, docs


def edits(rows):
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        out[i] = t[: len(t) - half] + nxt[:half]
    return out


def test_edits_and_likeness(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in df.collect()}
    got = merkle.fingerprints(df.repartition(5)).collect()
    want = edits(rows.items())
    assert {r.doc_id: r.edited_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    by_text = {}
    for r in got:
        assert r.n_chars == len(rows[r.doc_id])
        by_text.setdefault(rows[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    long = [r for r in got if r.n_chars > 800]
    assert sum(r.near_edited > 0.35 for r in long) > 0.9 * len(long)
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def test_roots_and_branches(spark):
    a, b = "one\ntwo\n\nthree\nfour", "one\ntwo\n\nthree\nFOUR"
    df = spark.createDataFrame([(a, b), (a, a), ("", ""), ("x\n\n", "x\n\n\n"), ("\n\na \n \nb\r\n", "c\n \nd"), (a, a + "\n\nmore")], "a string, b string")
    df = merkle.fingerprint(merkle.fingerprint(df, "a", "fa"), "b", "fb")
    got = merkle.with_likeness(df, "fa", "fb", "near").select((F.col("fa") == F.col("fb")).alias("same"), merkle.differing_branches("fa", "fb").alias("d"), "near").collect()
    assert [r.same for r in got] == [False, True, True, False, False, False]
    assert [tuple(x) for x in got[0].d] == [(1, 1)]
    assert got[1].d == [] and got[2].d == [] and got[3].d != []
    assert got[0].near == pytest.approx(3 / 4) and got[1].near == got[2].near == 1.0


def units(text):
    """Words with the white space behind them; characters of unspaced scripts, likewise, alone."""
    out, at = [], 0
    space = lambda c: c in " \t\n\v\f\r"
    for k in range(1, len(text) + 1):
        c = ord(text[k - 1])
        if k == len(text) or not space(text[k]) and (space(text[k - 1]) or 0xE00 <= c <= 0xD7FF or c >= 0xF900):
            out.append(text[at:k])
            at = k
    return out


def plain_tree(text):
    """root, [(section, [(paragraph, [leaf])])], by hashlib and xxhash alone."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c, name in ("\x03d", "\x02c", "\x01b", "\x00a"):
        text = text.replace(c, "\x03" + name)
    end = lambda u: "" if "\n" not in u or not u.strip(" \t\n\v\f\r") else "\x02" if "\n\n" in u else "\x01"
    marked = "".join("\x00" * (xxhash.xxh64_intdigest(u, 42) % 8 == 0) + u + end(u) for u in units(text))
    sections = []
    for s in filter(None, marked.split("\x02")):
        own = []
        for p in filter(None, s.split("\x01")):
            leaves = [sha(x[k : k + 256]) for x in p.split("\x00") if x for k in range(0, len(x), 256)]
            own.append((sha("".join(leaves)), leaves))
        sections.append((sha("".join(p for p, _ in own)), own))
    return sha("".join(s for s, _ in sections)), sections


def likeness(a, b):
    """Leaves in branches that can be paired with equal ones, level by level."""
    n = sum(len(ls) for t in (a, b) for _, ps in t[1] for _, ls in ps)
    x, y = a[1], b[1]
    for cut in (16, 12):
        left, right = (Counter((s[:cut], repr(below)) for s, below in z) for z in (x, y))
        x, y = ([p for (_, below), k in c.items() for _ in range(k) for p in eval(below)] for c in (left - right, right - left))  # noqa: S307
    left, right = (Counter(z[:8] for z in w) for w in (x, y))
    return 1 - ((left - right).total() + (right - left).total()) / n if n else 1.0


def test_nodes_and_likeness_against_hashlib(spark):
    """Every fingerprint, and near_edited and near_next, rebuilt in plain Python."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in df.collect()}
    changed, order = edits(rows.items()), sorted(rows, reverse=True)
    after = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    trees = {i: plain_tree(t) for i, t in rows.items()}
    for r in merkle.fingerprints(df).collect():
        own = trees[r.doc_id]
        root, branches = r.fingerprint.split("|")
        assert root == own[0]
        assert branches == ";".join(s[:16] + "=" + ",".join(p[:12] + ":" + ".".join(x[:8] for x in ls) for p, ls in below) for s, below in own[1])
        assert r.near_edited == pytest.approx(likeness(own, plain_tree(changed[r.doc_id])))
        assert r.near_next == pytest.approx(likeness(own, trees[after[r.doc_id]]))


def near(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = merkle.with_likeness(merkle.fingerprint(merkle.fingerprint(df, "a", "fa"), "b", "fb"), "fa", "fb", "near").select("a", "b", "near").collect()
    by = {(r.a, r.b): r.near for r in got}
    return [by[p] for p in pairs]


def test_an_inserted_character_changes_its_leaf_alone(spark):
    a = " ".join(f"word{i}," if i % 5 == 0 else f"word{i}" for i in range(200))
    assert near(spark, [(a, a[:500] + "x" + a[500:])])[0] > 0.9


def test_unrelated_texts_have_nothing_in_common(spark):
    pairs = [("alpha beta\n\ngamma delta\n", "one two\n\nthree four\n"), ("", "beta\n"), ("a\n", "b\n"), ("x y z", ""), ("", "")]
    assert near(spark, pairs) == [0.0, 0.0, 0.0, 0.0, 1.0]


def test_half_of_a_text_in_any_script(spark):
    """Half of the text stays, whether it has spaces, marks, lines, many words or one."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 9)))
    latin = " ".join(word() for _ in range(400))
    kana = "".join(chr(r.randrange(0x3041, 0x3097)) for _ in range(1200))
    han = "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(1200))
    thai = "".join(chr(r.randrange(0xE01, 0xE2F)) for _ in range(900))
    one, run, nul = "same " * 600, "x" * 4000, "a\x00b\x01 " * 300
    for text in (latin, kana, han, thai, one, run, nul):
        half = len(text) // 2
        other = "".join(r.choices("qwertyuiop ", k=half))
        got, same = near(spark, [(text, text[: len(text) - half] + other), (text, text)])
        assert 0.3 <= got <= 0.8 and same == 1.0, text[:20]


def test_texts_that_only_differ_in_marks(spark):
    texts = ["a\x00b c", "a\x01\x02b c", "a\x01b c", "a\x01\x01b c", "ab c"]
    df = merkle.fingerprint(spark.createDataFrame([(t,) for t in texts], "a string"), "a", "f")
    assert len({r.f for r in df.collect()}) == len(texts)


def test_awkward_rows(spark):
    rows = awkward()[:-1]  # without the repeated doc_id
    got = merkle.fingerprints(docs(spark, rows)).collect()
    want = edits([r[:2] for r in rows])
    assert {r.doc_id: r.edited_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert len(merkle.fingerprints(docs(spark)).collect()) == len(awkward())
    assert merkle.fingerprints(docs(spark, [])).count() == 0
    one = merkle.fingerprints(docs(spark, rows[5:6])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_no_python_in_the_plan(spark):
    plan = merkle.fingerprints(docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
