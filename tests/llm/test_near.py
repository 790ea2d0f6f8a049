import random
import re

import numpy as np

from sightline.llm import kernels, minhash_dedup, neardup, paragraph_dedup
from tests.conftest import SF01
from tests.llm.cases import awkward, docs


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def closure(sets, num, den):
    """Smallest reachable key of each key, by comparing all pairs."""
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                common = len(x & y)
                if den * common >= num * (len(x) + len(y) - common):
                    p, q = root(a), root(b)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
    return {k: root(k) for k in sets}


def check(df):
    sets = {r.doc_id: shingles(r.text) for r in df.collect()}
    want = closure(sets, 85, 100)
    got = minhash_dedup.near_duplicates(df).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in df.collect())
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def family(n, seed, words=60):
    """Edited copies of one text, edits adding up, so that links form chains and many pairs of a bucket don't link."""
    r = random.Random(seed)
    base = [f"v{r.randrange(500)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.choice((0, 1, 1, 2, 3, 4))):
            w[r.randrange(words)] = f"e{r.randrange(1000)}"
        out.append((i, " ".join(w)))
    return out


def test_documents_match_brute_force(spark):
    check(spark.read.parquet(f"{SF01}/documents.parquet"))


def test_blocks_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    check(spark.createDataFrame(family(150, 4), "doc_id long, text string"))


def test_awkward_rows(spark):
    rows = awkward()[:-1]
    check(docs(spark, rows))
    got = minhash_dedup.near_duplicates(docs(spark)).collect()
    assert len(got) == len(awkward())
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0
    kept = minhash_dedup.kept_documents(docs(spark, rows))
    assert kept.columns == docs(spark).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept and r.doc_id < 45} - ({42} if not any(r.doc_id == 42 and r.kept for r in got) else set())


def test_batches_of_few_words():
    for n in range(8):
        text = " ".join("abcdefgh"[:n])
        buf, cuts = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
        h, counts, _ = kernels.words(buf, cuts)
        assert [len(x) for x in kernels.shingle_sets(h, counts)] == [max(1, n - 4) if n else 0]


def test_rows_that_share_a_doc_id(spark):
    """A doc_id's texts are linked each by itself, and in the kept rows each has its own fate."""
    r = random.Random(2)
    one, two = ([f"{c}{r.randrange(10**6)}" for _ in range(60)] for c in "ab")
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join(one)), (3, " ".join([*two[:59], "x"])), (None, " ".join(two) + " y"), (None, "none"), (4, "a b"), (5, None)]
    df = spark.createDataFrame([(*x, "same", 7) for x in rows], "doc_id long, text string, row string, owner int")
    got = sorted((x.doc_id is None, x.doc_id or 0, x.n_shingles, x.component_id, x.kept) for x in minhash_dedup.near_duplicates(df).collect())
    assert got == [(False, 1, 56, 1, True), (False, 1, 56, 1, True), (False, 2, 56, 1, False), (False, 3, 56, 1, False), (False, 4, 1, 4, True), (False, 5, 0, 5, True), (True, 0, 1, None, True), (True, 0, 57, 1, False)]
    kept = minhash_dedup.kept_documents(df)
    assert kept.columns == df.columns
    assert {(x.doc_id, x.text) for x in kept.collect()} == {rows[0], rows[1], rows[5], rows[6], rows[7]}


def paragraphs(rows, least):
    out = {}
    for i, t in rows:
        at = 0
        for k, line in enumerate((t or "").split("\n")):
            if len(re.findall(r"[^\x20\x09-\x0D]+", line)) >= least:
                out[i, k] = (at, at + len(line), shingles(line))
            at += len(line) + 1
    return out


def check_paragraphs(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    every = paragraphs(rows, paragraph_dedup.MIN_WORDS)
    want = closure({k: v[2] for k, v in every.items()}, 80, 100)
    size = {}
    for k, v in want.items():
        size[v] = size.get(v, 0) + 1
    expected = {(*k, *every[k][:2], *v, size[v], k == v) for k, v in want.items() if size[v] > 1}
    got = {(r.doc_id, r.paragraph, r.start, r.stop, r.owner_doc_id, r.owner_paragraph, r.copies, r.kept) for r in paragraph_dedup.repeated_paragraphs(df).collect()}
    assert got == expected
    return got


def test_paragraphs_match_brute_force(spark):
    df = spark.read.parquet(f"{SF01}/documents.parquet").where("doc_id < 450")
    got = check_paragraphs(df)
    cut = {r.doc_id: r.text for r in paragraph_dedup.without_repeats(df).collect()}
    gone = {(g[0], g[1]) for g in got if not g[7]}
    assert cut == {r.doc_id: "\n".join(line for k, line in enumerate(r.text.split("\n")) if (r.doc_id, k) not in gone) for r in df.collect()}


def test_paragraphs_of_awkward_rows(spark):
    rows = [(i, t, "en", "s", 1, "c", "k", 1, "x", "y", "z") for i, t in enumerate([None, "", "\n\n", " ".join("é日\U0001f600abc"[i % 5] + str(i) for i in range(30)), "x\n" + " ".join("é日\U0001f600abc"[i % 5] + str(i) for i in range(30)) + "\n"])]
    assert len(check_paragraphs(docs(spark, rows))) == 2
    assert paragraph_dedup.repeated_paragraphs(docs(spark, [])).count() == 0
    assert paragraph_dedup.without_repeats(docs(spark)).columns == docs(spark).columns
