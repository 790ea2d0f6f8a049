import time

import pyarrow as pa

from sightline.llm import neardup, paragraph_dedup
from sightline.llm.common import Scratch
from tests.llm.test_passages import filler, passage


def shuffle_bytes(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in map(files.apply, range(files.size())) if f.getName().startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_bytes(spark)
    kept = Scratch(spark, "test").keep(spark.range(100_000).repartition(7, "id"), "dealt")
    until = time.time() + 20
    while (left := sum(size for name, size in shuffle_bytes(spark).items() if name not in before)) and time.time() < until:
        time.sleep(0.2)
    assert not left and kept.count() == 100_000


def test_pairs_of_blocks_run_over_batches():
    """Links don't depend on where Arrow cuts the rows."""
    sets = {0: range(20), 1: range(1, 21), 2: range(100, 120), 3: range(101, 121), 4: range(40)}
    rows = [(key, 0, 0, r, r + 10, 0, list(sets[r])) for key in (5, 6, 7) for r in (sorted(sets) if key != 6 else [0, 4])]
    rows += [(8, 0, 1, r, r + 10, int(r % 2), list(sets[r])) for r in range(4)]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["key", "i", "j", "rep", "comp", "block", "hashes"])
    want = [(10, 11), (12, 13)] * 3
    for step in (1, 2, 3, 7, len(rows)):
        parts = [whole.slice(k, step) for k in range(0, len(rows), step)]
        got = [p for b in neardup.block_links(80, 100)(iter(parts)) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert got == want


def test_windows_are_held_against_paragraphs_without_their_texts(monkeypatch):
    """What is shuffled to the spans is the places of windows, and their keys are those of a plain count."""
    monkeypatch.setattr(paragraph_dedup, "PLACED", 50)
    p = " ".join(passage(4, 60))
    texts = [f"{filler(1, 70)} {p} {filler(2, 30)}", "short", f"{filler(3, 40)}\n{p}\n{p}"]
    (batch,) = paragraph_dedup._places(iter([pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array(texts)], ["row", "text"])]))
    assert batch.schema.names == ["row", "keys", "counts"] and batch.column(0).to_pylist() == [7, 9]
    counts = [list(c) for c in batch.column(2).to_pylist()]
    assert [sum(c) for c in counts] == [len(texts[k].split()) - paragraph_dedup.WINDOW + 1 for k in (0, 2)] and max(map(max, counts)) <= 13
    span = {"word": 100, "words": 60, "kept": False, "same": True, "ordinal": 2, "owner_row": 9, "owner_ordinal": 1}
    kind = pa.list_(pa.struct([(n, pa.bool_() if n in ("kept", "same") else pa.int64()) for n in paragraph_dedup.SPAN]))
    for spans, copies in ((None, 2), ([span], 1)):
        own = pa.RecordBatch.from_arrays([*batch.columns, pa.array([None, spans], kind)], [*batch.schema.names, "spans"])
        got = {(r["row"], r["key"]): (r["n"], r["live"], r["free"]) for b in paragraph_dedup._keys(iter([own])) for r in b.to_pylist()}
        shared = {k for r, k in got if r == 7} & {k for r, k in got if r == 9}
        assert shared and {got[9, k] for k in shared} >= {(copies,) * 3} and {got[7, k] for k in shared} == {(1, 1, 1)}
