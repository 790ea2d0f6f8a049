"""Operator 5: repeated passages, by MinHash bands over paragraphs with exact Jaccard, and by overlapping word windows wherever lines break."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import Scratch, by_value, fits_broadcast, row_key, semi_join, slices, text_or_empty
from sightline.llm.kernels import band_keys, circulant_signatures, fingerprint, list_array, mix64, shingle_sets, string_buffer, words
from sightline.llm.neardup import BUCKETS, class_components, link_classes

#: Paragraphs of fewer words are left alone: only those without any.
MIN_WORDS = 1
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8**3)**13 = 9e-5.
BANDS, ROWS = 13, 3
NUM, DEN = 80, 100
#: Words of a window. Every stretch of so many words that recurs is found, whatever lines it runs over.
WINDOW = 20
#: Words of the runs whose least hash stands for a window; equal windows have equal ones.
RUN = 8
#: Repeated paragraphs up to so many (16 MB) are broadcast with their texts' rows; more are joined by a shuffle.
SPANS = 400_000
#: What is known of a repeated paragraph where windows are held against it.
SPAN = ("word", "words", "kept", "same", "ordinal", "owner_row", "owner_ordinal")
#: Texts whose paragraphs are hashed at a time.
TEXTS = 1000
#: Bytes of text whose windows are hashed at a time, and windows held against repeated paragraphs.
SLICE, PLACED = 1 << 20, 1 << 18


def _paragraphs(batch, min_words: int, text: int = 2):
    """Row of the batch, number, first and last code point, words, shingle set, a hash of the words in order, and the number of the first word in the text, of each paragraph of at least min_words words. text: number of the column."""
    buf, offsets = string_buffer(batch.column(text))
    # line feeds are white space, so paragraphs can be hashed as rows of their own
    feeds = np.flatnonzero(buf == 10) + 1
    cuts = np.unique(np.concatenate((offsets, feeds)))
    h, counts, _ = words(buf, cuts)
    row = np.searchsorted(offsets, cuts[:-1], side="right") - 1
    number = np.arange(len(cuts) - 1) - np.searchsorted(cuts[:-1], offsets[row])
    # code points: bytes that don't continue one
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    ends = np.concatenate(([0], np.cumsum(counts)))
    keep = np.flatnonzero(counts >= min_words)
    first = points[cuts[keep]] - points[offsets[row[keep]]]
    stop = cuts[keep + 1] - ((cuts[keep + 1] > 0) & (buf[np.maximum(cuts[keep + 1] - 1, 0)] == 10))
    last = points[stop] - points[offsets[row[keep]]]
    some = np.concatenate([h[ends[k] : ends[k + 1]] for k in keep]) if len(keep) else np.zeros(0, np.uint64)
    order = np.array([xxhash.xxh3_64_intdigest(h[ends[k] : ends[k + 1]].tobytes()) for k in keep], np.uint64)
    word = ends[keep] - ends[np.searchsorted(cuts, offsets[row[keep]])]
    return row[keep], number[keep], first, last, counts[keep], shingle_sets(some, counts[keep]), order, word


def _signatures(min_words: int, bands: int, rows: int, alone: int):
    def run(batches):
        for batch in slices(batches, TEXTS):
            at, number, first, last, counts, sets, order, word = _paragraphs(batch, min_words)
            ordinal = np.arange(len(at)) - np.searchsorted(at, at)
            if not len(at):
                continue
            some = [s for s in sets if len(s) > alone]
            keys = iter(band_keys(circulant_signatures(some, bands * rows), bands, rows)) if some else iter(())
            none = np.zeros(0, np.uint64)
            of = batch.select([0, 1]).take(pa.array(at))
            cols = [*of.columns, *(pa.array(c.astype(np.int64)) for c in (number, first, last, counts, word, ordinal)), pa.array(order.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary()), list_array([next(keys) if len(s) > alone else none for s in sets])]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "paragraph", "start", "stop", "words", "word", "ordinal", "content", "n", "fp", "bands"])

    return run


def _sets(min_words: int):
    def run(batches):
        for batch in slices(batches, TEXTS):
            sets = _paragraphs(batch, min_words, 1)[5]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()), list_array(sets)], ["fp", "hashes"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text); row stands for a doc_id with its text."""
    text = text_or_empty()
    return docs.select(row_key(F.col("doc_id"), text).alias("row"), "doc_id", text.alias("text"))


def _paragraph_rows(texts: DataFrame, scratch: Scratch, min_words: int, num: int, den: int) -> DataFrame:
    """repeated_paragraphs with the row of each text and the owner's place."""
    # a set of n shingles reaches at best n / (n + 1) with another that isn't equal: up to these it needs no bands, as equal sets are one class anyway
    alone = max(0, -(-num // (den - num)) - 1) if num < den else 0
    found = scratch.keep(texts.mapInArrow(_signatures(min_words, BANDS, ROWS, alone), "row long, doc_id long, paragraph long, start long, stop long, words long, word long, ordinal long, content long, n long, fp binary, bands array<long>"), "found")

    def sets_of(wanted: DataFrame) -> DataFrame:
        of = semi_join(texts, scratch.keep(wanted.select("row").distinct(), "ids"), "row").select("row", "text")
        return semi_join(of.mapInArrow(_sets(min_words), "fp binary, hashes array<long>"), wanted.select("fp"), "fp")

    place = F.struct("doc_id", "paragraph", "start", "stop", "row", "ordinal", "content")
    classes, linked = link_classes(found.select("row", place.alias("order"), "n", "fp", "bands"), sets_of, num, den, scratch)
    known = scratch.keep(class_components(classes, linked, scratch), "owned")
    placed = scratch.keep(found.drop("n", "bands").join(F.broadcast(known) if fits_broadcast(known, BUCKETS // 4) else known, "fp").drop("fp"), "placed")
    copies = scratch.keep(placed.groupBy("component").agg(F.count("*").alias("copies")), "copies")
    kept = F.col("row").eqNullSafe(F.col("owner.row")) & (F.col("paragraph") == F.col("owner.paragraph"))
    each = placed.join(F.broadcast(copies) if fits_broadcast(copies, BUCKETS) else copies, "component")
    return each.select("row", "doc_id", "paragraph", "start", "stop", "words", "word", "ordinal", "content", "owner", "copies", kept.alias("kept"))


def _columns(rows: DataFrame) -> DataFrame:
    owner = [F.col(f"owner.{c}").alias(f"owner_{c}") for c in ("doc_id", "paragraph", "start", "stop")]
    return rows.select("doc_id", "paragraph", "start", "stop", "words", *owner, "copies", "kept")


def repeated_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per paragraph with words that has a near copy: doc_id, paragraph, start, stop, words, owner_doc_id, owner_paragraph, owner_start, owner_stop, copies, kept.

    Paragraphs end with a line feed; those of min_words words or more whose
    distinct five-word shingles (A-Z lower-cased) reach num / den in Jaccard similarity are linked, and linked ones form components. Of each the
    paragraph of the smallest doc_id, then the first in it, is the owner and is kept; the others are the removals. copies counts the
    component, start and stop are code points in the text, paragraph counts from 0.

    Null text counts as empty; texts without such paragraphs give no row. A repeated doc_id has rows for each of its texts; a null one counts as the smallest. An empty table gives an empty one; other columns are ignored.
    """
    return _columns(_paragraph_rows(_texts(docs), Scratch(docs.sparkSession, "paragraphs"), min_words, num, den))


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; at the last n - 1 words it means nothing."""
    out, power = h.copy(), 1
    for k in range(1, n):
        power = power * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        out[: len(h) - k] += h[k:] * np.uint64(power)
    return mix64(out)


def _windows(col: pa.Array):
    """For slices of a column of texts: their first row and bytes and offsets, then of each window its row, its first word in the slice, the least hash of its runs and where that is (the last such place), and of each word the hash and the byte at which it begins, and of each row the first word."""
    buf, offsets = string_buffer(col)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, side="right")) - 1)
        part, cuts = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        h, counts, begins = words(part, cuts)
        ends = np.concatenate(([0], np.cumsum(counts)))
        row = np.repeat(np.arange(hi - lo), counts)
        first = np.flatnonzero(ends[row + 1] - np.arange(len(h)) >= WINDOW)
        if len(first):
            runs = _runs(h, RUN)
            least, place = runs[first], first.copy()
            for k in range(1, WINDOW - RUN + 1):
                x = runs[first + k]
                less = x <= least
                least[less], place[less] = x[less], first[less] + k
            yield lo, part, cuts, row[first], first, least, place, h, begins, ends
        lo = hi


def _lie(spans: pa.Array, first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window (by its first word) 3 if it is mirrored, 2 if all its words are in removed paragraphs, 1 if they are all in repeated ones, else 0; and whether any is in a removed one. spans: repeated paragraphs of each row; ends: its first word.

    A window is mirrored if it lies in removed paragraphs that follow each other as their owners do in one text, word for word: so the owners' text has it too, in
    paragraphs that stay, and says of every other place what this one would.
    """
    row = np.repeat(np.arange(len(spans)), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
    of = dict(zip(SPAN, (x.to_numpy(zero_copy_only=False) for x in spans.flatten().flatten()), strict=True))
    order = np.lexsort((of["word"], row))
    row, of = row[order], {k: x[order] for k, x in of.items()}
    a = ends[row] + of["word"]
    b = a + of["words"]
    same, gone = of["same"].astype(bool), ~of["kept"].astype(bool)
    goes_on = np.zeros(len(row), bool)
    follows = [of[k][1:] == of[k][:-1] + step for k, step in (("ordinal", 1), ("owner_row", 0), ("owner_ordinal", 1))]
    goes_on[1:] = same[1:] & same[:-1] & (row[1:] == row[:-1]) & np.logical_and.reduce(follows)
    block = np.where(same, np.cumsum(~goes_on), 0)

    def over(weight: np.ndarray) -> np.ndarray:
        out = np.zeros(int(ends[-1]) + 1, np.int64)
        np.add.at(out, a, weight)
        np.add.at(out, b, -weight)
        return np.cumsum(out)

    before = lambda x: np.concatenate(([0], np.cumsum(x)))
    removed, told, mirror = before(over(gone.astype(np.int64))), before(over(np.ones(len(a), np.int64))), over(block)
    lost, known = removed[first + WINDOW] - removed[first], told[first + WINDOW] - told[first]
    state = np.where(lost == WINDOW, 2, np.where(known == WINDOW, 1, 0))
    state[(mirror[first] > 0) & (mirror[first] == mirror[first + WINDOW - 1])] = 3
    return state, lost > 0


def _points(buf: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))


def _places(batches):
    """Of each text with windows the least hash of each place that stands for windows, in their order, and for how many (at most WINDOW - RUN + 1) it does: a byte each."""
    for batch in slices(batches, TEXTS):
        for lo, _, cuts, row, _, least, place, _, _, _ in _windows(batch.column(1)):
            # windows with the same place follow each other
            new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (place[1:] != place[:-1]))))
            counts = np.diff(np.append(new, len(row))).astype(np.uint8)
            ends = np.searchsorted(row[new], np.arange(len(cuts)))
            some = np.flatnonzero(np.diff(ends))
            keys = pa.ListArray.from_arrays(pa.array(np.append(ends[some], len(new)).astype(np.int32)), pa.array(least[new].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some + lo)), keys, pa.array([counts[ends[r] : ends[r + 1]].tobytes() for r in some], pa.binary())], ["row", "keys", "counts"])


def _keys(batches):
    """The distinct least hashes of each text's windows, without mirrored ones, and at how many places they are, two standing for more: in all, with a window outside removed and outside all repeated paragraphs."""
    for whole in slices(batches, TEXTS):
        bounds, lo = np.cumsum([sum(c) for c in whole.column(2).to_pylist()]), 0
        while lo < len(bounds):
            hi = max(lo + 1, int(np.searchsorted(bounds, (bounds[lo - 1] if lo else 0) + PLACED, side="right")))
            batch, lo = whole.slice(lo, hi - lo), hi
            least = batch.column(1).flatten().to_numpy().view(np.uint64)
            of = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column(1)).to_numpy())
            counts = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).astype(np.int64)
            windows = np.bincount(of, counts, len(batch)).astype(np.int64)
            # a text has WINDOW - 1 words more than windows
            ends = np.concatenate(([0], np.cumsum(windows + WINDOW - 1)))
            first = np.arange(int(windows.sum())) + np.repeat(np.arange(len(batch)) * (WINDOW - 1), windows)
            # a place has the state of its freest window
            state = np.minimum.reduceat(_lie(batch.column(3), first, ends)[0], np.cumsum(counts) - counts)
            some = state < 3
            row, key, state = of[some], least[some], state[some]
            if not len(row):
                continue
            order = np.lexsort((key, row))
            row, key, state = row[order], key[order], state[order]
            new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1]))))
            sums = [np.minimum(np.add.reduceat(x, new, dtype=np.int32), 2) for x in (state >= 0, state < 2, state < 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[new])), pa.array(key[new].view(np.int64)), *map(pa.array, sums)], ["row", "key", "n", "live", "free"])


def _candidates(batches):
    """The windows of each text whose least hash is among its keys, and how they lie to its repeated paragraphs."""
    for batch in slices(batches, TEXTS):
        keys = batch.column(3)
        for lo, buf, cuts, row, first, least, _, h, begins, ends in _windows(batch.column(2)):
            hit, points = np.zeros(len(first), bool), _points(buf)
            for r in range(len(cuts) - 1):
                a, b = np.searchsorted(row, (r, r + 1))
                if a < b:
                    hit[a:b] = np.isin(least[a:b], keys[lo + r].values.to_numpy().view(np.uint64))
            if not hit.any():
                continue
            state, cut = _lie(batch.column(4).slice(lo, len(cuts) - 1), first[hit], ends)
            hit[hit], state, cut = state < 3, state[state < 3], cut[state < 3]
            at, home = first[hit], cuts[row[hit]]
            feeds = np.concatenate(([0], np.cumsum(buf == 10)))
            # the end of a word: behind the last byte before the next word that is no white space
            space = (buf == 32) | ((buf >= 9) & (buf <= 13))
            close = np.maximum.accumulate(np.where(space, 0, np.arange(1, len(buf) + 1)))[np.append(begins[1:], len(buf)) - 1]
            start, stop = points[begins[at]] - points[home], points[close[at + WINDOW - 1]] - points[home]
            where = pa.array(row[hit] + lo)
            ints = [pa.array(c.astype(np.int32)) for c in (at - ends[row[hit]], feeds[begins[at]] - feeds[home], start, stop, state)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), *ints, pa.array(cut), pa.array(_runs(h, WINDOW)[at].view(np.int64))], ["row", "doc_id", "place", "paragraph", "start", "stop", "state", "cut", "window"])


def _passage_rows(texts: DataFrame, paragraphs: DataFrame, scratch: Scratch) -> DataFrame:
    """Runs of windows that occur at another place too, without those that the rows of `paragraphs` (a written table) tell already."""
    same = ~F.col("kept") & (F.col("content") == F.col("owner.content"))
    span = F.struct("word", "words", "kept", same.alias("same"), "ordinal", F.col("owner.row").alias("owner_row"), F.col("owner.ordinal").alias("owner_ordinal"))
    spans = scratch.keep(paragraphs.groupBy("row").agg(F.collect_set(span).alias("spans")), "spans")
    told = F.broadcast(spans) if fits_broadcast(paragraphs, SPANS) else spans
    # places travel to the spans, not texts
    places = texts.select("row", "text").mapInArrow(_places, "row long, keys array<long>, counts binary")
    keys = places.join(told, "row", "left").select("row", "keys", "counts", "spans").mapInArrow(_keys, "row long, key long, n int, live int, free int")
    keys = scratch.keep(keys, "keys")
    # all places of a window have the same key, so what its key lacks it lacks too
    shared = scratch.keep(keys.groupBy("key").agg(F.sum("n").alias("n"), F.sum("live").alias("live"), F.sum("free").alias("free")).where("n > 1 and (live > 1 or free > 0)").select("key"), "shared")
    hits = semi_join(keys.select("row", "key"), shared, "key").groupBy("row").agg(F.collect_set("key").alias("keys"))
    hits = scratch.keep(hits, "hits")
    scratch.drop(keys, shared)
    own = semi_join(texts, scratch.keep(hits.select("row"), "rows"), "row").join(hits, "row").dropDuplicates(["row"]).join(told, "row", "left").select("row", "doc_id", "text", "keys", "spans")
    found = own.mapInArrow(_candidates, "row long, doc_id long, place int, paragraph int, start int, stop int, state int, cut boolean, window long")
    found = scratch.keep(found, "windows")
    owner = F.min(F.struct("cut", "doc_id", "row", "place", "paragraph", "start", "stop"))
    groups = found.groupBy("window").agg(F.count("*").alias("n"), F.count_if(F.col("state") < 2).alias("live"), F.count_if(F.col("state") == 0).alias("free"), owner.alias("o"))
    # written, so that the join reads both sides by window and a hot one is split
    groups = scratch.keep(groups.where("n > 1 and (live > 1 or free > 0)").select("window", "n", "o"), "groups")
    kept = (F.col("row") == F.col("o.row")) & (F.col("place") == F.col("o.place"))
    each = found.where("state < 2").join(F.broadcast(groups) if fits_broadcast(groups, SPANS // 4) else groups, "window").select("row", "doc_id", "place", "paragraph", "start", "stop", "n", "o", kept.alias("kept"))
    order = Window.partitionBy("row", "o.row", "kept").orderBy("place")
    each = each.withColumn("run", F.col("place") - F.row_number().over(order))
    runs = each.groupBy("row", "doc_id", F.col("o.row").alias("owner_row"), F.col("o.doc_id").alias("owner_doc_id"), "kept", "run")
    long = lambda c: c.cast("long")
    runs = runs.agg(*(long(f(c)).alias(c) for f, c in ((F.min, "paragraph"), (F.min, "start"), (F.max, "stop"))), long(F.max("place") - F.min("place") + WINDOW).alias("words"), long(F.min("o.paragraph")).alias("op"), long(F.min("o.start")).alias("os"), long(F.max("o.stop")).alias("oe"), F.max("n").alias("copies"))
    return runs.select("row", "doc_id", "paragraph", "start", "stop", "words", F.struct(F.col("owner_doc_id").alias("doc_id"), F.col("op").alias("paragraph"), F.col("os").alias("start"), F.col("oe").alias("stop")).alias("owner"), "copies", "kept")


def repeats(docs: DataFrame) -> DataFrame:
    """The rows of repeated_paragraphs, and one for each passage besides that recurs word for word: the same columns and unit, `paragraph` or `passage`.

    A passage is a run of windows of WINDOW words (A-Z lower-cased) each of which occurs at another place, in the same or another text;
    lines may break anywhere in it. So every repeated stretch of WINDOW words or more is covered for certain, and nothing else is: windows
    are compared by 64-bit hashes of all their words. paragraph is the line in which a passage begins. Of each window the place
    of the smallest doc_id, then text, then the first, is the owner and is kept, one without words of removed paragraphs before all others; copies is the most
    places of one window. What a removal shares with a kept passage of the same text is to stay.

    Windows within removed paragraphs count as places (in copies only those that don't mirror the owners' text) but give no row, and kept ones within paragraphs give none unless a copy elsewhere has one. Rows equal in doc_id and
    text are one place. Null text counts as empty; an empty table gives an empty one.
    """
    paragraphs, passages = _repeats(_texts(docs), Scratch(docs.sparkSession, "repeats"))
    return _columns(paragraphs).withColumn("unit", F.lit("paragraph")).union(_columns(passages).withColumn("unit", F.lit("passage")))


def _repeats(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    first = Scratch(texts.sparkSession, "paragraphs")
    paragraphs = scratch.keep(_paragraph_rows(texts, first, MIN_WORDS, NUM, DEN), "paragraphs")
    first.clear()
    return paragraphs, _passage_rows(texts, paragraphs, scratch)


def _cut(text: str, lines: set[int], gone: list[tuple[int, int]], stay: list[tuple[int, int]]) -> str:
    """A text without some lines, and of the others without the characters that lie in gone but not in stay."""
    flags = np.zeros(len(text) + 1, bool)
    for a, b in gone:
        flags[a:b] = True
    for a, b in stay:
        flags[a:b] = False
    out, at = [], 0
    for k, line in enumerate(text.split("\n")):
        if k not in lines:
            part = flags[at : at + len(line)]
            out.append("".join(c for c, f in zip(line, part.tolist(), strict=True) if not f) if part.any() else line)
        at += len(line) + 1
    return "\n".join(out)


def _cut_batches(text: int):
    def run(batches):
        for batch in slices(batches, TEXTS):
            own, cuts = batch.column(text).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for k, some in enumerate(cuts):
                if some:
                    own[k] = _cut(own[k], {x["paragraph"] for x in some if x["unit"] == "paragraph"}, *([(x["start"], x["stop"]) for x in some if x["unit"] == "passage" and x["kept"] == kept] for kept in (False, True)))
            cols = [pa.array(own, batch.column(text).type) if k == text else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    return run


def without_repeats(docs: DataFrame, passages: bool = False, **how) -> DataFrame:
    """docs with the removals cut out of text; every row stays, other columns as they were.

    Removed paragraphs go with their line feed. With passages also every removed passage goes, but for what it shares with a kept passage of the same text.
    """
    scratch = Scratch(docs.sparkSession, "cut")
    if passages:
        lines, more = _repeats(_texts(docs), scratch)
        unit = lambda df, name: df.select("row", F.struct(F.lit(name).alias("unit"), "paragraph", "start", "stop", "kept").alias("cut"))
        rows = unit(lines.where("not kept"), "paragraph").union(unit(more, "passage"))
    else:
        rows = _paragraph_rows(_texts(docs), scratch, how.get("min_words", MIN_WORDS), how.get("num", NUM), how.get("den", DEN)).where("not kept").select("row", F.struct(F.lit("paragraph").alias("unit"), "paragraph", "start", "stop", "kept").alias("cut"))
    cuts = scratch.keep(rows.groupBy("row").agg(F.collect_set("cut").alias("cuts")), "cuts")
    joined = docs.join(cuts, row_key(docs["doc_id"], F.coalesce(docs["text"], F.lit(""))) == cuts["row"], "left").select(*(docs[c] for c in docs.columns), cuts["cuts"])
    return joined.mapInArrow(_cut_batches(docs.columns.index("text")), docs.schema)


by_value(__name__)
