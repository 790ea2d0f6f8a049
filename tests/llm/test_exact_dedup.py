import hashlib

from sightline.llm import exact_dedup
from tests.conftest import SF01
from tests.llm.cases import awkward, docs


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        norm = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(norm, []).append((-len(text or ""), doc_id))
    return {(i, min(v)[1], len(v), i == min(v)[1], hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items() for _, i in v}


def test_matches_brute_force(spark):
    df = spark.read.parquet(f"{SF01}/documents.parquet")
    got = {tuple(r) for r in exact_dedup.exact_duplicates(df).collect()}
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def test_awkward_rows(spark):
    got = exact_dedup.exact_duplicates(docs(spark)).collect()
    assert len(got) == len(awkward())
    assert {tuple(r) for r in got} == brute([r[:2] for r in awkward()])
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0
    kept = exact_dedup.kept_documents(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.doc_id for r in got if r.kept})


def test_rows_that_share_a_doc_id(spark):
    """Each text keeps one row: a doc_id's other text stays, twins are one, a row without doc_id goes like any other."""
    rows = [(0, "shared"), (1, "shared"), (1, "only here"), (5, "twin"), (5, "twin"), (None, "shared "), (None, "alone"), (None, "alone"), (7, ""), (8, None)]
    kept = exact_dedup.kept_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row long"))
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in kept.collect()) == sorted([(False, 1, "only here"), (False, 5, "twin"), (True, None, "shared "), (True, None, "alone"), (False, 7, "")], key=lambda x: (x[0], x[1] or 0, x[2])) or {(r.doc_id, r.text) for r in kept.collect()} == {(1, "only here"), (5, "twin"), (None, "shared "), (None, "alone"), (7, "")}


def test_trie_splits_and_counts():
    t = exact_dedup.Trie()
    for i, word in enumerate((b"", b"abc", b"abd", b"ab", b"abc", b"x" * 5000, b"x" * 4999 + b"y")):
        t.insert(word, [1, i, i, 1, 1])
    assert {k: (o[1], o[3]) for k, o in t.entries()} == {b"": (0, 1), b"abc": (1, 2), b"abd": (2, 1), b"ab": (3, 1), b"x" * 5000: (5, 1), b"x" * 4999 + b"y": (6, 1)}
    # strings share what they begin with, as long as none ends there
    assert set(t.root[1]) == {ord("a"), ord("x")} and t.root[1][ord("a")][0] == b"ab" and len(t.root[1][ord("x")][0]) == 4999


def test_trie_gives_up_its_largest_subtrees():
    t, want = exact_dedup.Trie(), {}
    for i in range(400):
        word = (b"common prefix %d " % (i % 3)) * 3 + b"%d" % i + b"z" * (i % 50)
        t.insert(word, [1, i, i, 1, 1])
        want[word] = i
    held = t.bytes
    assert held == t.weight(t.root) - exact_dedup.NODE
    gone = {k: o[1] for k, o in t.give_up(held // 2)}
    left = {k: o[1] for k, o in t.entries()}
    assert t.bytes <= held // 2 and t.bytes == t.weight(t.root) - exact_dedup.NODE
    assert gone and left and not gone.keys() & left.keys() and {**gone, **left} == want
    assert dict((k, o[1]) for k, o in t.give_up(0)) == left and not t.root[1]


def test_owners_with_small_memory(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", 1000)
    df = spark.read.parquet(f"{SF01}/documents.parquet")
    got = {tuple(r) for r in exact_dedup.exact_duplicates(df).collect()}
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])
