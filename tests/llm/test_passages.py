import random
import re

from sightline.llm import paragraph_dedup
from sightline.llm import queries as corpus
from tests.conftest import SF
from tests.llm.cases import docs


def places(rows):
    """(doc_id, place) of every word, lower-cased, with the code points at which it begins and ends."""
    return {i: [(m.group().lower() if m.group().isascii() else re.sub("[A-Z]", lambda x: x.group().lower(), m.group()), *m.span()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for i, t in rows}


def repeated_words(rows, n):
    """doc_id and first code point of the words of windows of n words that occur at another place."""
    at = {}
    of = places(rows)
    for i, w in of.items():
        for k in range(len(w) - n + 1):
            at.setdefault(tuple(x[0] for x in w[k : k + n]), []).append((i, k))
    return {(i, of[i][k + j][1]) for v in at.values() if len(v) > 1 for i, k in v for j in range(n)}


def covered(rows, got):
    of = places(rows)
    return {(r.doc_id, a) for r in got for _, a, b in of[r.doc_id] if r.start <= a and b <= r.stop}


def check(spark, df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = paragraph_dedup.repeats(df).collect()
    want = repeated_words(rows, paragraph_dedup.WINDOW)
    assert not want - covered(rows, got)
    passages = [r for r in got if r.unit == "passage"]
    assert covered(rows, passages) <= want
    text = dict(rows)
    for r in passages:
        assert len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id][r.start : r.stop])) == r.words
    return got


def passage(seed, n=50):
    r = random.Random(seed)
    return [f"p{r.randrange(10**6)}é" for _ in range(n)]


def filler(seed, n):
    r = random.Random(f"f{seed}")
    return " ".join(f"f{r.randrange(10**6)}" for _ in range(n))


def test_passages_in_longer_lines_and_across_line_breaks(spark):
    p = passage(1)
    inside = f"{filler(1, 200)} {' '.join(p)} {filler(2, 200)}"
    broken = f"{filler(3, 90)}\n{filler(4, 60)} {' '.join(p[:17])}\n{' '.join(p[17:33])}\n\n{' '.join(p[33:])} {filler(5, 80)}"
    apart = f"{filler(6, 100)} {' '.join(p[:19])} x {' '.join(p[31:])}"
    rows = [(7, inside), (3, broken), (5, apart), (9, None), (11, " ".join(["a"] * 300)), (12, filler(9, 30))]
    got = check(spark, docs(spark, [(*r, *[None] * 9) for r in rows]))
    found = {(r.doc_id, r.words, r.owner_doc_id, r.copies, r.kept, rows[0][1][r.start : r.stop] == " ".join(p)) for r in got if r.doc_id in (3, 5, 7)}
    assert found == {(3, 50, 3, 2, True, False), (7, 50, 3, 2, False, True)}
    (r,) = [r for r in got if r.doc_id == 7]
    assert broken[r.owner_start : r.owner_stop].split() == p and (r.owner_paragraph, r.paragraph) == (1, 0)


def test_every_repeated_stretch_of_the_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert any(r.unit == "passage" for r in check(spark, df))


def test_registered_query_reports_passages(spark, tmp_path):
    p = " ".join(passage(2))
    docs(spark, [(i, f"{filler(i, 300)} {p} {filler(i + 50, 300)}", *[None] * 9) for i in range(2)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus.QUERIES["op5_paragraph_repeats"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.kept) for r in got} == {(0, True), (1, False)}


def test_short_lines_are_compared(spark):
    nine = "one two three four five six seven eight Nine"
    rows = [(1, f"{nine}\n{filler(1, 30)}"), (2, f"{filler(2, 30)}\n{nine.lower()}\nyes"), (3, "yes"), (4, "a b c d e f g h"), (5, "a b c d e f g h i"), (6, "a b c d e f g"), (7, "no")]
    got = paragraph_dedup.repeated_paragraphs(docs(spark, [(*r, *[None] * 9) for r in rows])).collect()
    assert {(r.doc_id, r.paragraph, r.owner_doc_id, r.copies) for r in got} == {(1, 0, 1, 2), (2, 1, 1, 2), (2, 2, 2, 2), (3, 0, 2, 2), (4, 0, 4, 2), (5, 0, 4, 2)}


def test_rows_without_doc_id_keep_the_links_of_their_class(spark):
    line = " ".join(f"w{i}" for i in range(40))
    rows = [(None, line), (1, line), (2, line + " more")]
    for order in (rows, rows[::-1]):
        got = paragraph_dedup.repeated_paragraphs(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert {(r.doc_id, r.owner_doc_id, r.copies, r.kept) for r in got} == {(None, None, 3, True), (1, None, 3, False), (2, None, 3, False)}


def test_windows_of_every_length_from_the_bound_on(spark):
    for n in (19, 20, 25, 39):
        p = " ".join(passage(n, n))
        rows = [(i, f"{filler(10 * i, 120)} {p} {filler(10 * i + 1, 120)}") for i in range(4)]
        got = check(spark, docs(spark, [(*r, *[None] * 9) for r in rows]))
        assert {(r.doc_id, r.words, r.kept) for r in got} == (set() if n < 20 else {(i, n, i == 0) for i in range(4)})


def test_passages_next_to_whole_copies(spark):
    """Copied lines in a row, alone, in another order and inside a longer line: every repeated window is told."""
    lines = [" ".join(passage(50 + k, 8 + 5 * k)) for k in range(6)]
    rows = [(1, "\n".join(lines)), (2, "\n\n".join(lines) + f"\n{filler(1, 20)}"), (3, "\n".join([lines[0], lines[1], filler(2, 9), lines[4], lines[5]])), (4, "\n".join([lines[5], lines[1], lines[0], lines[4]])), (5, f"{filler(3, 40)} {lines[1]} {lines[2]} {lines[3]} {filler(4, 40)}"), (6, f"{filler(5, 30)} {lines[1]} {lines[0]} {filler(6, 30)}"), (7, lines[0].upper() + "\n" + lines[1])]
    check(spark, docs(spark, [(*r, *[None] * 9) for r in rows]))


def test_removal_leaves_one_of_each_passage(spark):
    p = " ".join(passage(3))
    rows = [(i, f"{filler(10 * i, 60)} {p} {filler(10 * i + 1, 60)}\ncommon line of five words or so") for i in range(5)]
    df = docs(spark, [(*r, *[None] * 9) for r in rows])
    cut = paragraph_dedup.without_repeats(df, passages=True)
    assert cut.columns == df.columns
    left = {r.doc_id: r.text for r in cut.collect()}
    assert [i for i, t in sorted(left.items()) if p in t] == [0] and left[0] == rows[0][1]
    for i in range(1, 5):
        head, tail = rows[i][1].split("\n")[0].split(f" {p} ")
        assert left[i] == f"{head}  {tail}"
    assert not [r for r in paragraph_dedup.repeats(cut).collect() if r.unit == "passage"]
