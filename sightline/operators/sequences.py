"""Ordered observations: bounds by neighbours, consistent subsequences, offsets, runs and duplicates."""

from __future__ import annotations

import bisect
import sys

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

OPEN = 2**63 - 1


def neighbour_bounds(df: DataFrame, by: list[str], order: list[str], value: str, known: str) -> DataFrame:
    """Adds hi and lo: the nearest known value before and after a row, open at the ends; its own doesn't count."""
    w = Window.partitionBy(*by).orderBy(*order)
    v = F.when(F.col(known), F.col(value))
    hi = F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    lo = F.first(v, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn("hi", F.coalesce(hi, F.lit(OPEN))).withColumn("lo", F.coalesce(lo, F.lit(0)))


def longest_falling(values: list) -> list[bool]:
    """Members of the longest non-increasing subsequence; of equals the one with the earliest end, then the earliest predecessors.

    tails holds, for each length, the largest last value that a subsequence of
    it can have; negated it ascends, so each length is found by halving. Of the rows of a length that may come before, the first is taken.
    """
    length, rows, tails = [], [], []
    for k, v in enumerate(values):
        n = bisect.bisect_right(tails, -v)
        tails[n : n + 1] = [-v]
        length.append(n)
        if n == len(rows):
            rows.append([])
        rows[n].append(k)
    keep = [False] * len(values)
    if rows:
        at = rows[-1][0]
        keep[at] = True
        for n in range(length[at] - 1, -1, -1):
            at = next(k for k in rows[n] if k < at and values[k] >= values[at])
            keep[at] = True
    return keep


def consistent(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds keep: whether a row is in its group's longest non-increasing subsequence. A group is one capture, some hundred rows."""

    return _by_group(df, by, order, lambda rows: (longest_falling(rows[value]),), "keep boolean")


class _Rows(dict):
    """The columns of one group as lists, each made when it is asked for."""

    def __init__(self, column, lo: int, hi: int):
        super().__init__()
        self.column, self.lo, self.hi = column, lo, hi

    def __missing__(self, name: str) -> list:
        return self.setdefault(name, self.column(name)[self.lo : self.hi])


def _starts(rows: pa.Table, by: list[str]) -> list[int]:
    """Where a group begins, in rows that lie group by group."""
    new = pa.array([False] * (rows.num_rows - 1), pa.bool_())
    for c in by:
        a, b = rows.column(c).slice(1).combine_chunks(), rows.column(c).slice(0, rows.num_rows - 1).combine_chunks()
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new = pc.or_(new, differs)
    return [0, *(pc.indices_nonzero(new).to_numpy() + 1).tolist()]


def _by_group(df: DataFrame, by: list[str], order: list[str], fold, extra: str) -> DataFrame:
    """df with the columns of `extra`, which fold gives for the columns (as lists) of one group in order. A group is one capture, so it is bounded.

    Groups lie one behind the other in sorted partitions and are taken as they come in Arrow batches, as a call of Python for each costs more than its rows.
    """
    add = StructType.fromDDL(extra)
    schema = StructType([*df.schema.fields, *add.fields])
    kinds = to_arrow_schema(add)

    def folded(rows: pa.Table, starts: list[int]) -> list[pa.RecordBatch]:
        lists: dict[str, list] = {}

        def column(name: str) -> list:
            if name not in lists:
                lists[name] = rows.column(name).to_pylist()
            return lists[name]

        out: list[list] = [[] for _ in kinds]
        for lo, hi in zip(starts, [*starts[1:], rows.num_rows], strict=True):
            for values, more in zip(out, fold(_Rows(column, lo, hi)), strict=True):
                values.extend(more)
        for field, values in zip(kinds, out, strict=True):
            rows = rows.append_column(field.name, pa.array(values, field.type))
        return rows.to_batches()

    def run(batches):
        left: list[pa.RecordBatch] = []  # of a group that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            # of what is left one row tells whether the group goes on
            ahead = [left[-1].slice(left[-1].num_rows - 1), batch] if left else [batch]
            seen = pa.Table.from_batches(ahead)
            starts = _starts(seen, by)
            cut = starts[-1] - (1 if left else 0)
            if starts[-1] == 0:
                left.append(batch)
                continue
            done = pa.Table.from_batches([*left, batch.slice(0, cut)])
            yield from folded(done, _starts(done, by))
            left = [batch.slice(cut)]
        if left:
            done = pa.Table.from_batches(left)
            yield from folded(done, _starts(done, by))

    return df.repartition(*by).sortWithinPartitions(*by, *(F.asc_nulls_last(c) for c in order)).mapInArrow(run, schema)


def spaced(df: DataFrame, by: list[str], order: list[str], at: str, gap: float) -> DataFrame:
    """Adds accepted: whether a row lies more than gap beyond the last one accepted, in order; a fold, since a dropped row does not count."""

    def fold(rows):
        out, last = [], None
        for y in rows[at]:
            out.append(last is None or y > last + gap)
            last = y if out[-1] else last
        return (out,)

    return _by_group(df, by, order, fold, "accepted boolean")


def collected(df: DataFrame, by: list[str], order: list[str], at: str, reach: float, resolves: str) -> DataFrame:
    """Adds place and action: the first collected row within reach (inclusive) of a sighting, or a new one, and what becomes of the sighting.

    new rows are collected; one seen before is read again until a reading resolves it, then skipped.
    """

    def fold(rows):
        known, done, places, actions = [], [], [], []
        for y, good in zip(rows[at], rows[resolves], strict=True):
            k = next((k for k, x in enumerate(known) if abs(x - y) <= reach), len(known))
            if k == len(known):
                known.append(y)
                done.append(False)
                actions.append("new")
            else:
                actions.append("skipped" if done[k] else "read again")
            done[k] = done[k] or good
            places.append(k)
        return places, actions

    return _by_group(df, by, order, fold, "place int, action string")


def first_known(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Per key the first value that is known, in order; later ones don't replace it. A partial aggregate, no window."""
    return df.groupBy(*by).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias(value))


def confirmed_bands(df: DataFrame, by: list[str], order: str, confirmed: str, depth: int = 1) -> DataFrame:
    """(by, first, last, bands): the longest run of consecutive confirmed boundaries (the first of equals; two at least), and once more what lies before and after it."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("_n", F.row_number().over(w)).withColumn("_part", F.lit(""))
    found = None
    for level in range(depth + 1):
        rows = rows.where(confirmed) if level == 0 else rows
        part = Window.partitionBy(*by, "_part").orderBy("_n")
        islands = rows.withColumn("_g", F.col("_n") - F.row_number().over(part)).groupBy(*by, "_part", "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.min("_n").alias("_lo"), F.max("_n").alias("_hi"), F.count("*").alias("_len"))
        best = islands.where("_len > 1").groupBy(*by, "_part").agg(F.max_by(F.struct("first", "last", "_lo", "_hi", "_len"), F.struct("_len", -F.col("_lo"))).alias("_b")).select(*by, "_part", "_b.*")
        one = best.select(*by, "first", "last", (F.col("_len") - 1).alias("bands"))
        found = one if found is None else found.union(one)
        if level < depth:
            side = F.when(F.col("_n") < F.col("_lo"), "l").when(F.col("_n") > F.col("_hi"), "r")
            rows = rows.join(best.select(*by, "_part", "_lo", "_hi"), [*by, "_part"]).withColumn("_side", side).where("_side is not null").withColumn("_part", F.concat("_part", "_side")).drop("_lo", "_hi", "_side")
    return found


def peak_and_decoys(df: DataFrame, by: list[str], at: str, score: str, apart: int, decoys: int = 3) -> DataFrame:
    """Per key: place and height of the highest score (the first of equals), and the heights of the best ones further away than `apart`."""
    top = df.groupBy(*by).agg(F.max_by(F.struct(F.col(at).alias("peak_at"), F.col(score).alias("peak")), F.struct(score, -F.col(at))).alias("_p")).select(*by, "_p.*")
    far = df.join(top, by).where(F.abs(F.col(at) - F.col("peak_at")) > apart)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), at))
    rest = far.withColumn("_k", rank).where(F.col("_k") <= decoys).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", score))), lambda x: x[score]).alias("decoys"))
    return top.join(rest, by, "left").withColumn("decoys", F.coalesce("decoys", F.array().cast("array<double>"))).withColumn("margin", F.col("peak") - F.get("decoys", F.lit(0)))


def free_windows(bands: DataFrame, by: list[str], lo: str, hi: str, top, bottom, least: float) -> DataFrame:
    """What bands leave free between top and bottom, at least so high: (by, start, stop). Bands may overlap."""
    w = Window.partitionBy(*by).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    inner = bands.select(*by, F.greatest(F.coalesce(F.max(hi).over(w), F.lit(top)), F.lit(top)).alias("start"), F.col(lo).alias("stop"))
    tail = bands.groupBy(*by).agg(F.greatest(F.max(hi), F.lit(top)).alias("start")).withColumn("stop", F.lit(bottom))
    return inner.unionByName(tail.select(*by, "start", F.col("stop").cast(inner.schema["stop"].dataType).alias("stop"))).where((F.col("stop") > F.col("start")) & (F.col("stop") - F.col("start") >= least))


def renumbered(frames: DataFrame, by: list[str], groups: str, order: str) -> DataFrame:
    """Frames of several groups one behind the other, seq counting from 0 through all of them."""
    return frames.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy(groups, order)) - 1)


def content_offset(df: DataFrame, by: list[str], order: list[str], offset: str) -> DataFrame:
    """Adds content_y: running offset, the first frame's own not counted."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("content_y", F.sum(offset).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.first(offset).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def group_offset(df: DataFrame, by: list[str], order: list[str], offset: str, present: str) -> DataFrame:
    """Adds group_y: running offset over frames whose predecessor showed the group too."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_add", F.when(F.col(present) & F.lag(present, 1, False).over(w), F.col(offset)).otherwise(0)).withColumn("group_y", F.sum("_add").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_add")


def runs(df: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """Islands of consecutive flagged rows: run, first, last and length."""
    w = Window.partitionBy(*by).orderBy(order)
    numbered = df.withColumn("_n", F.row_number().over(w)).where(flag)
    numbered = numbered.withColumn("_g", F.col("_n") - F.row_number().over(w))
    return numbered.groupBy(*by, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_g")


def as_of(rows: DataFrame, marks: DataFrame, by: list[str], at: str, what: str, default) -> DataFrame:
    """Adds what: that of the last mark at or before each row, else the default. Both sides are merged and scanned once per key."""
    union = rows.select(*by, at, *[c for c in rows.columns if c not in (*by, at)], F.lit(None).cast(marks.schema[what].dataType).alias(what), F.lit(1).alias("_row")).unionByName(marks.select(*by, at, what, F.lit(0).alias("_row")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "_row").rowsBetween(Window.unboundedPreceding, 0)
    return union.withColumn(what, F.coalesce(F.last(what, ignorenulls=True).over(w), F.lit(default))).where("_row = 1").drop("_row")


def complete_scroll(df: DataFrame, by: list[str], order: list[str], offset: str, still: int = 3, most: int = 40, reach: float | None = None) -> DataFrame:
    """Per capture: complete once `still` offsets in a row are 0, within `most` frames; overshot if an offset before that exceeds what can be measured."""
    w = Window.partitionBy(*by).orderBy(*order)
    last = F.sum(F.when(F.col(offset) == 0, 1).otherwise(0)).over(w.rowsBetween(1 - still, 0))
    marked = df.withColumn("_n", F.row_number().over(w)).withColumn("_s", last)
    done = F.min(F.when((F.col("_s") == still), F.col("_n")))
    far = F.min(F.when(F.col(offset) > reach, F.col("_n"))) if reach is not None else F.lit(None).cast("int")
    out = marked.groupBy(*by).agg(done.alias("done_at"), far.alias("_far"), F.count("*").alias("frames"))
    over = F.col("_far").isNotNull() & (F.col("_far") <= most) & (F.col("done_at").isNull() | (F.col("_far") < F.col("done_at")))
    return out.withColumn("status", F.when(over, "overshot").when(F.col("done_at") <= most, "complete").otherwise("incomplete")).drop("_far")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
