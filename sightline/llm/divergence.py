"""Operator 12: audit of how the term shares of a language's sources diverge. Vectors of groups stay where they are and meet those of their peers in tournament rounds."""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import Scratch, by_value, fits_broadcast, numbered

#: Documents of a language in which a term is kept.
SUPPORT = 3
#: Shares are whole numbers, of so many parts.
PARTS = 1_000_000_000
#: Terms that a group reports, by rank.
TOP = 200
#: Terms of a block, the unit in which a vector is stored and travels; fits two bytes.
BLOCK = 1 << 16
#: Tournament rounds played in one pass; each vector travels once a round.
ROUNDS = 8
#: Distinct terms that a task counts before it hands its counts on.
MEMO = 400_000
#: Bytes of text searched at a time.
SLICE = 1 << 20
TERM = re.compile(rb"[a-z\x80-\xff]+")


def _terms(text: bytes):
    """The terms of a text, some at a time; cuts are made at bytes that belong to none."""
    lo = 0
    while lo < len(text):
        hi = lo + SLICE
        gap = re.compile(rb"[^A-Za-z\x80-\xff]").search(text, hi) if hi < len(text) else None
        hi = gap.start() if gap else len(text)
        yield TERM.findall(text[lo:hi].lower())
        lo = hi


def _count(batches):
    """Rows (lang, source, term, n, docs) of what a task has counted: occurrences and documents of each term, and under a null term the group's documents."""
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    held = 0

    def flush():
        for (lang, source), own in counts.items():
            of = docs[lang, source]
            keys = list(own)
            terms = pa.array([None if k is None else k.decode() for k in keys], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array([source] * len(keys)), terms, pa.array(list(own.values()), pa.int64()), pa.array([of[k] for k in keys], pa.int64())], ["lang", "source", "term", "n", "docs"])
        counts.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own, of = counts.setdefault((lang, source), Counter()), docs.setdefault((lang, source), Counter())
            before = len(own)
            seen: set = set()
            for terms in _terms(text.encode()):
                own.update(terms)
                seen.update(terms)
            of.update(seen)
            own[None] += 0
            of[None] += 1
            held += len(own) - before
            if held > MEMO:
                yield from flush()
                held = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and documents that have it; a null term has the documents of the group.

    Terms are runs of letters A to Z, in lower case, and of everything beyond ASCII. Null text, lang and source count as ''. Tasks count what they
    read before anything is shuffled.
    """
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = plain.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(PARTS * (n + 1) / (total + kept)), exact."""
    wide = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"1 + (cast({PARTS} as decimal(10,0)) * ({wide(n)} + 1)) div ({wide(total)} + {wide(kept)})").cast("long")


def _slices(batches):
    """Rows (lang, g, block, ids, shares), one for each group and block, of rows (lang, g, block, id, p) that come in that order."""
    head, ids, shares = None, [], []

    def row():
        return pa.RecordBatch.from_arrays([pa.array([head[0]]), pa.array([head[1]], pa.int32()), pa.array([head[2]], pa.int64()), pa.array([np.concatenate(ids).astype("<u2").tobytes()]), pa.array([np.concatenate(shares).astype("<u4").tobytes()])], ["lang", "g", "block", "ids", "shares"])

    for batch in batches:
        if not batch.num_rows:
            continue
        lang, g, block = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        # lang and g change together with neither missed: rows are sorted by all three
        code = lang.dictionary_encode().indices.to_numpy()
        edges = np.concatenate(([0], np.flatnonzero((np.diff(code) != 0) | (np.diff(g) != 0) | (np.diff(block) != 0)) + 1, [batch.num_rows]))
        each_id, each_p = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            now = (lang[int(a)].as_py(), int(g[a]), int(block[a]))
            if now != head:
                if head is not None:
                    yield row()
                head, ids, shares = now, [], []
            ids.append(each_id[a:b])
            shares.append(each_p[a:b])
    if head is not None:
        yield row()


def _vector(ids: bytes, shares: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids or b"", "<u2").astype(np.int64), np.frombuffer(shares or b"", "<u4").astype(np.int64)


def _meet(batches):
    """Of each meeting of two groups over a block: the sums of both directions over the terms that either has, and how many those are."""
    for batch in batches:
        out = []
        for ids, shares, none, peer_ids, peer_shares, peer_none in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True):
            (at, p), (peer_at, q) = _vector(ids, shares), _vector(peer_ids, peer_shares)
            both = np.union1d(at, peer_at)
            own, other = np.full(len(both), none, np.int64), np.full(len(both), peer_none, np.int64)
            own[np.searchsorted(both, at)], other[np.searchsorted(both, peer_at)] = p, q
            apart = (own - other) ** 2
            out.append((int((apart // other).sum()), int((apart // own).sum()), len(both)))
        there, back, n = (pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ((), (), ())))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], there, back, n], ["lang", "g", "peer", "there", "back", "met"])


class _Worst:
    """Orders a heap by the term to leave first: the least value, then the last place."""

    __slots__ = ("place", "value")

    def __init__(self, value: int, place: int):
        self.value, self.place = value, place

    def __lt__(self, other):
        return (self.value, -self.place) < (other.value, -other.place)


def _rank(top: int):
    """Rows (lang, g, place, value) of the terms with the greatest values of each group in a task, from meetings of groups with their language."""

    def run(batches):
        heaps: dict[tuple[str, int], list[_Worst]] = {}
        for batch in batches:
            for lang, g, block, ids, shares, of_ids, of_shares in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (at, p), (of_at, of) = _vector(ids, shares), _vector(of_ids, of_shares)
                q = of[np.searchsorted(of_at, at)]  # a term of a group is one of its language
                heap = heaps.setdefault((lang, g), [])
                some = np.flatnonzero(p > q)
                value = (p[some] - q[some]) ** 2 // q[some]
                if len(some) > top:  # ties at the bound stay, the heap decides them
                    least = np.partition(value, len(value) - top)[len(value) - top]
                    some, value = some[value >= least], value[value >= least]
                for v, k in zip(value.tolist(), at[some].tolist(), strict=True):
                    entry = _Worst(v, block * BLOCK + k)
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    elif heap[0] < entry:
                        heapq.heapreplace(heap, entry)
        for (lang, g), heap in heaps.items():
            if heap:
                n = len(heap)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([g] * n, pa.int32()), pa.array([x.place for x in heap], pa.int64()), pa.array([x.value for x in heap], pa.int64())], ["lang", "g", "place", "value"])

    return run


def opponent(g: str, groups: str, rnd: str) -> str:
    """SQL of whom a group (from 0) meets in a round (from 0) of a tournament of `groups` (made even by a bye); the last seat stays, the others turn."""
    seats = f"({groups} + {groups} % 2)"
    return f"CASE WHEN {g} = {seats} - 1 THEN {rnd} WHEN {g} = {rnd} THEN {seats} - 1 ELSE pmod(2 * {rnd} - {g}, {seats} - 1) END"


def _tournament(vectors: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """(lang, g, peer, there, back, met) of each two groups of a language, from whole vectors (lang, g, groups, block, ids, shares, none) that have a row for every block.

    In each round a group meets one peer. The one whose seat is lower, or higher if the seats add up to an even number, stays; the other's slices come to
    it, block by block, and both directions are evaluated there. A task holds two slices at a time.
    """
    host = "CASE WHEN (g + opponent) % 2 = 1 THEN least(g, opponent) ELSE greatest(g, opponent) END"
    results = []
    for lo in range(0, max(most + most % 2 - 1, 0), ROUNDS):
        at = vectors.withColumn("round", F.explode(F.sequence(F.lit(lo), F.lit(lo + ROUNDS - 1)))).where("groups > 1 and round < groups + groups % 2 - 1")
        at = at.withColumn("opponent", F.expr(f"cast({opponent('g', 'groups', 'round')} as int)")).where(f"opponent < groups and ({host}) = opponent")
        guests = at.select("lang", F.col("opponent").alias("g"), "block", F.col("g").alias("peer"), *(F.col(c).alias(f"peer_{c}") for c in ("ids", "shares", "none")))
        meetings = vectors.drop("groups").join(guests, ["lang", "g", "block"]).select("lang", "g", "peer", "ids", "shares", "none", "peer_ids", "peer_shares", "peer_none")
        met = meetings.mapInArrow(_meet, "lang string, g int, peer int, there long, back long, met long")
        results.append(scratch.keep(met.groupBy("lang", "g", "peer").agg(*(F.sum(c).alias(c) for c in ("there", "back", "met"))), f"round{lo}"))
    out = results[0] if results else None
    for more in results[1:]:
        out = out.union(more)
    return out


def source_divergence(docs: DataFrame, support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank for each group (lang, source) of documents.

    A language keeps the terms that `support` of its documents have. A group's share of a kept term is 1 + floor(PARTS * (count + 1) / (N + V)), with N the
    count of all its V kept terms. Part `pair`: each other source of the language with the sum over kept terms of floor((p - q)^2 / q), q being the
    other's shares. Part `term`: the `top` kept terms of a group whose share is greater than the language's, q, by the same value. Ranks are from 1 by falling value, then by the item's bytes.

    Null text, lang and source count as ''. Every row is a document, also if it is repeated. Groups without terms take part in pairs. Terms, vectors and meetings are spread
    by block, so a group of a third of all rows is many rows. An empty table gives an empty one; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.keep(term_counts(docs), "counts")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= support).drop("docs")
    terms = scratch.keep(numbered(terms, ["lang", "term"], scratch).withColumns({"block": F.expr(f"place div {BLOCK}"), "id": (F.col("place") % BLOCK).cast("int")}), "terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total"), F.min("block").alias("lo"), F.max("block").alias("hi"))
    entries = scratch.keep(counts.where("term is not null").join(terms.select("lang", "term", "block", "id"), ["lang", "term"]).select("lang", "source", "block", "id", "n"), "entries")
    # one row for each group, and for each language
    order = Window.partitionBy("lang").orderBy("source")
    groups = counts.where("term is null").select("lang", "source", (F.row_number().over(order) - 1).cast("int").alias("g"), F.count("*").over(Window.partitionBy("lang")).cast("int").alias("groups"))
    groups = groups.join(entries.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs.withColumnRenamed("total", "lang_total"), "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    groups = scratch.keep(groups.withColumn("none", F.when(F.col("kept") > 0, _share("0", "total", "kept")).otherwise(F.lit(0))), "groups")
    small = lambda df: F.broadcast(df) if fits_broadcast(df, 100_000) else df

    own = entries.join(small(groups), ["lang", "source"]).select("lang", "g", "block", "id", _share("n", "total", "kept").alias("p"))
    whole = terms.join(small(scratch.keep(langs, "langs").withColumnRenamed("total", "lang_total")), "lang").select("lang", F.lit(-1).alias("g"), "block", "id", _share("n", "lang_total", "kept").alias("p"))
    rows = own.union(whole).repartition("lang", "g", "block").sortWithinPartitions("lang", "g", "block", "id")
    packed = scratch.keep(rows.mapInArrow(_slices, "lang string, g int, block long, ids binary, shares binary"), "slices")
    scratch.drop(entries)

    grid = groups.where("kept > 0").select("lang", "g", "groups", "none", F.explode(F.expr("sequence(lo, hi)")).alias("block"))
    vectors = scratch.keep(grid.join(packed.where("g >= 0"), ["lang", "g", "block"], "left"), "vectors")
    most = groups.where("kept > 0").agg(F.max("groups")).first()[0] or 0

    met = _tournament(vectors, scratch, most)
    sides = groups.select("lang", "g", "source", "none", "kept")
    every = groups.select("lang", "g", "source", "none", "kept").join(sides.select("lang", F.col("g").alias("peer"), F.col("source").alias("item"), F.col("none").alias("peer_none")), "lang").where("g <> peer")
    if met is None:
        pairs = every.select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    else:
        both = met.select("lang", "g", "peer", F.col("there").alias("value"), "met").union(met.select("lang", F.col("peer").alias("g"), F.col("g").alias("peer"), "back", "met"))
        rest = F.expr("(kept - met) * (((none - peer_none) * (none - peer_none)) div peer_none)")
        pairs = every.join(both, ["lang", "g", "peer"], "left").select("lang", "source", "item", F.when(F.col("kept") > 0, F.col("value") + rest).otherwise(F.lit(0)).cast("long").alias("value"))
    ranked = lambda df, last: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), last)).cast("int"))
    pairs = ranked(pairs, "item").select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    meetings = packed.where("g >= 0").join(packed.where("g < 0").select("lang", "block", F.col("ids").alias("of_ids"), F.col("shares").alias("of_shares")), ["lang", "block"]).select("lang", "g", "block", "ids", "shares", "of_ids", "of_shares")
    best = meetings.mapInArrow(_rank(top), "lang string, g int, place long, value long").join(groups.select("lang", "g", "source"), ["lang", "g"])
    best = scratch.keep(ranked(best, "place").where(F.col("rank") <= top).select("lang", "source", "place", "value", "rank"), "best")
    names = terms.select("place", F.col("term").alias("item"))
    best = names.join(small(best), "place").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.union(best)


by_value(__name__)
