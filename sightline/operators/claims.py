"""Closed-set assignment: captures that fit in a task as they come in Arrow batches, larger ones by joins and aggregates, in rounds of claims that no later one could contest."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sightline.functions import names
from sightline.functions.names import ACCEPT
from sightline.operators import nearest
from sightline.operators.nearest import Forms
from sightline.operators.resolve import CONFIDENT, DUPLICATE, FLOOR, MARGIN, RESIDUAL, TAKEN, assign
from sightline.operators.sequences import _starts
from sightline.streaming.runner import scratch

#: Cells of a capture's matrix, rows by members, up to which one task claims it; and those up to which matrices are claimed together.
CELLS, SMALL = 1_000_000, 256


def _round(cells: DataFrame, free: DataFrame, by: str, least: int, lead: int) -> DataFrame:
    """(by, row, member, score) of claims that single claims, the best first, would all come to.

    A row is fit if its best free member scores `least` and leads the next free one (0 if it has no cell) by `lead`; the lead is void if one member is left. A fit row that is the best
    free row of its member too (the first of equals) will get it, whatever is claimed before. Such rows are claimed at once down to the first place where single claims might go on with another:
    that of a fit row that isn't sure, or that of a row that can only become fit by a claim on its best or next member, from that claim or its own place on, whichever is later. A first row
    that isn't sure is claimed alone, as single claims would.
    """
    ranked = F.sort_array(F.collect_list(F.struct("score", (-F.col("member")).alias("m"))), asc=False)
    second = F.get("c", F.lit(1))
    rows = cells.groupBy(by, "row").agg(ranked.alias("c")).select(by, "row", F.col("c")[0]["score"].alias("score"), (-F.col("c")[0]["m"]).alias("member"), F.coalesce(second["score"], F.lit(0)).alias("next"), (-second["m"]).alias("other"))
    place = F.struct("score", (-F.col("row")).alias("r"))
    able = F.col("score") >= least
    rows = rows.where(able).join(free, by).withColumn("fit", (F.col("free") == 1) | (F.col("score") - F.col("next") >= lead)).withColumn("place", place)
    tops = cells.groupBy(by, "member").agg((-F.max(F.struct("score", (-F.col("row")).alias("r")))["r"]).alias("first"))
    fit = rows.where("fit").join(tops, [by, "member"]).select(by, "row", "member", "score", (F.col("first") == F.col("row")).alias("sure"), "place")
    claims = fit.where("sure").select(by, F.col("member").alias("on"), F.col("place").alias("at"))
    touched = rows.where("not fit").select(by, "row", "place", F.explode(F.array_compact(F.array("member", "other"))).alias("on")).join(claims, [by, "on"])
    freed = touched.groupBy(by, "row").agg(F.least(F.max("at"), F.first("place")).alias("stop")).groupBy(by).agg(F.max("stop").alias("stop"))
    fit = fit.join(freed, by, "left")
    whole = Window.partitionBy(by)
    fit = fit.withColumn("bar", F.max(F.when(~F.col("sure"), F.col("place"))).over(whole))
    before: Column = F.col("sure") & (F.col("bar").isNull() | (F.col("place") > F.col("bar"))) & (F.col("stop").isNull() | (F.col("place") >= F.col("stop")))
    fit = fit.withColumn("now", before).withColumn("some", F.max("now").over(whole))
    return fit.where(F.col("now") | (~F.col("some") & (F.col("place") == F.col("bar")))).select(by, "row", "member", "score")


def _together(scores: np.ndarray, rows: np.ndarray, members: np.ndarray, floor: int, margin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """resolve.assign of many matrices at once: scores (matrix, row, member), of which the first `rows` by `members` of each are its own."""
    n, r, m = scores.shape
    inside = (np.arange(r)[None, :, None] < rows[:, None, None]) & (np.arange(m)[None, None, :] < members[:, None, None])
    cells = np.where(inside, scores, TAKEN).astype(np.int32)
    member, score, phase = np.full((n, r), -1), np.zeros((n, r), np.int64), np.zeros((n, r), np.int64)
    for stage, least, lead in ((CONFIDENT, ACCEPT, 1), (RESIDUAL, floor, margin)):
        open_ = np.arange(n)
        while len(open_):
            c = cells[open_]
            column = c.argmax(2)
            best = np.take_along_axis(c, column[:, :, None], 2)[:, :, 0]
            np.put_along_axis(c, column[:, :, None], TAKEN, 2)
            second = c.max(2)
            fits = np.where((best >= least) & ((second == TAKEN) | (best - second >= lead)), best, -2)
            row = fits.argmax(1)
            at = np.arange(len(open_))
            some = fits[at, row] > -2
            open_, row, at = open_[some], row[some], at[some]
            col = column[at, row]
            member[open_, row], score[open_, row], phase[open_, row] = col, best[at, row], stage
            cells[open_, row, :] = TAKEN
            cells[open_, :, col] = TAKEN
        if stage == CONFIDENT:
            claimed = np.zeros((n, m), bool)
            g, k = np.nonzero(member >= 0)
            claimed[g, member[g, k]] = True
            again = (member < 0) & ((scores >= ACCEPT) & claimed[:, None, :] & inside).any(2)
            phase[again] = DUPLICATE
            cells[again] = TAKEN
    return member, score, phase


def _ranks(start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each key among the distinct ones of its group, how many there are, and (group, place, key) of each as columns."""
    order = np.lexsort((key, start))
    new = np.ones(len(key), bool)
    new[1:] = (start[order][1:] != start[order][:-1]) | (key[order][1:] != key[order][:-1])
    number = np.cumsum(new) - 1
    groups = start[order][new]
    first = np.searchsorted(groups, np.arange(start.max() + 1))
    place = np.empty(len(key), np.int64)
    place[order] = number - first[start[order]]
    return place, np.bincount(groups, minlength=start.max() + 1), np.stack([groups, np.arange(len(groups)) - first[groups], key[order][new]])


def _claimed(group: np.ndarray, row: np.ndarray, member: np.ndarray, score: np.ndarray, floor: int, margin: int) -> tuple[np.ndarray, ...]:
    """(group, row, member, score, phase) of each row of many groups, numbered from 0."""
    i, n_rows, rows = _ranks(group, row)
    j, n_members, members = _ranks(group, member)
    row_at, member_at = np.cumsum(n_rows) - n_rows, np.cumsum(n_members) - n_members
    got, points, phases = np.full(rows.shape[1], -1), np.zeros(rows.shape[1], np.int64), np.zeros(rows.shape[1], np.int64)
    power = lambda x: 1 << np.ceil(np.log2(np.maximum(x, 1))).astype(np.int64)
    height, width = power(n_rows), power(n_members)
    small = height * width <= SMALL
    for h, w in {(a, b) for a, b in zip(height[small].tolist(), width[small].tolist(), strict=True)}:
        same = np.flatnonzero(small & (height == h) & (width == w))
        of = np.full(len(n_rows), -1)
        of[same] = np.arange(len(same))
        mine = of[group] >= 0
        matrix = np.zeros((len(same), h, w), np.int32)
        np.maximum.at(matrix, (of[group[mine]], i[mine], j[mine]), score[mine])
        k, s, p = _together(matrix, n_rows[same], n_members[same], floor, margin)
        own = of[rows[0]] >= 0
        g, r = of[rows[0][own]], rows[1][own]
        found = k[g, r]
        got[own] = np.where(found < 0, -1, members[2][member_at[rows[0][own]] + np.maximum(found, 0)])
        points[own], phases[own] = s[g, r], p[g, r]
    for g in np.flatnonzero(~small):
        mine = group == g
        matrix = np.zeros((n_rows[g], n_members[g]), np.int64)
        np.maximum.at(matrix, (i[mine], j[mine]), score[mine])
        k, s, p = assign(matrix, floor, margin)
        own = slice(row_at[g], row_at[g] + n_rows[g])
        got[own] = np.where(k < 0, -1, members[2][member_at[g] + np.maximum(k, 0)])
        points[own], phases[own] = s, p
    return rows[0], rows[2], got, points, phases


def _in_tasks(scores: DataFrame, by: str, floor: int, margin: int) -> DataFrame:
    """Assignments of groups of up to CELLS cells: single claims, of many groups at once."""
    schema = StructType.fromDDL(f"{by} {scores.schema[by].dataType.simpleString()}, row int, member int, score int, phase int")
    kinds = to_arrow_schema(schema)

    def run(batches):
        left: list[pa.RecordBatch] = []

        def done(rows: pa.Table):
            starts = np.array(_starts(rows, [by]))
            group = np.zeros(rows.num_rows, np.int64)
            group[starts[1:]] = 1
            g, *found = _claimed(np.cumsum(group), *(rows.column(c).to_numpy().astype(np.int64) for c in ("row", "member", "score")), floor, margin)
            key = rows.column(by).take(pa.array(starts[g]))
            yield from pa.Table.from_arrays([key, *(pa.array(x.astype(np.int32)) for x in found)], schema=kinds).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(pa.Table.from_batches([left[-1].slice(left[-1].num_rows - 1), batch] if left else [batch]), [by])
            cut = starts[-1] - (1 if left else 0)
            if starts[-1] == 0:
                left.append(batch)
                continue
            yield from done(pa.Table.from_batches([*left, batch.slice(0, cut)]))
            left = [batch.slice(cut)]
        if left:
            yield from done(pa.Table.from_batches(left))

    return scores.select(by, "row", "member", "score").repartition(by).sortWithinPartitions(by).mapInArrow(run, schema)


def assignments(scores: DataFrame, by: str, floor: int = FLOOR, margin: int = MARGIN, most: int = CELLS) -> DataFrame:
    """(by, row, member, score, phase) of each row of (by, row, member, score): the result of resolve.assign for every group.

    A pair that isn't there scores 0; of repeated ones the highest holds. floor and margin are 1 at least. Groups of up to `most` cells, rows by members, and as many pairs are claimed in tasks, many at once, larger ones in rounds.
    """
    if floor < 1 or margin < 1:
        raise ValueError("floor and margin are 1 at least")
    size = scores.groupBy(by).agg(F.count("*").alias("_pairs")).where(F.col("_pairs") > math.isqrt(most)).select(by)
    if not size.limit(1).count():
        return _in_tasks(scores, by, floor, margin)
    size = scores.join(size, by, "left_semi").groupBy(by).agg(F.count("*").alias("_pairs"), F.count_distinct("row").alias("_r"), F.count_distinct("member").alias("_m"))
    which = nearest._keeper(scores, "large")(size.where(F.greatest(F.col("_pairs"), F.col("_r") * F.col("_m")) > most).select(by))
    few = _in_tasks(scores.join(which, by, "left_anti"), by, floor, margin)
    return few.unionByName(_in_rounds(scores.join(which, by, "left_semi"), by, floor, margin))


def confident(rows: DataFrame, members: DataFrame, by: str, text: str, name: str, score: Callable, forms: Forms) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The claims of the accepted score, of rows (by, row, text), one for each text of a row, and members (by, member, name): (by, row, member, score, phase) of the rows that are
    claimed or duplicates, and the rows and members that are left.

    Only scores from there on matter: those below can neither be claimed nor stand in the way. A row and a member that have no other such score are claimed at once.
    """
    keep = nearest._keeper(rows, "confident")
    met = nearest.reaching(rows, members, [by], text, name, ACCEPT, score, forms).join(rows, [by, text]).join(members, [by, name])
    cells = keep(met.groupBy(by, "row", "member").agg(F.max("score").cast("int").alias("score")))
    alone = lambda c: F.count("*").over(Window.partitionBy(by, c)) == 1
    cells = keep(cells.withColumn("alone", alone("row") & alone("member")))
    told = assignments(cells.where("not alone").drop("alone"), by, names.ACCEPT + 100, 1).where("phase > 0")
    told = keep(cells.where("alone").select(by, "row", "member", "score", F.lit(CONFIDENT).alias("phase")).unionByName(told))
    return told, rows.join(told.select(by, "row"), [by, "row"], "left_anti"), members.join(told.where("member >= 0").select(by, "member"), [by, "member"], "left_anti")


def remaining(rows: DataFrame, members: DataFrame, by: str, text: str, name: str, least: int, score: Callable) -> DataFrame:
    """(by, row, member, score) of what the accepted claims have left, scores of `least` or more; all of them if that is 0. Each distinct pair of texts is scored once."""
    texts = rows.where(F.col(text).isNotNull()).select(by, text).distinct().join(members.where(F.col(name).isNotNull()).select(by, name).distinct(), by).withColumn("score", score(F.col(text), F.col(name)))
    if least <= 0:
        every = rows.join(members, by).join(texts, [by, text, name], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    else:
        every = texts.where(F.col("score") >= least).join(rows, [by, text]).join(members, [by, name])
    return every.groupBy(by, "row", "member").agg(F.max("score").cast("int").alias("score"))


def named(rows: DataFrame, members: DataFrame, by: str, text: str, name: str, score: Callable, forms: Forms, floor: int = FLOOR, margin: int = MARGIN) -> DataFrame:
    """assignments of rows (by, row, text), one for each text of a row or null, to members (by, member, name) by the best score of the row's texts, without all pairs.

    The claims of the accepted score come from texts within few edits; then what is left is compared with what is left. A score too low to be claimed, and too low for one that can be
    claimed to lead it by less than the margin, doesn't matter.
    """
    told, left, free = confident(rows, members, by, text, name, score, forms)
    cells = nearest._keeper(rows, "remaining")(remaining(left, free, by, text, name, floor - margin + 1, score))
    told = told.unionByName(assignments(cells, by, floor, margin).where("member >= 0"))
    out = rows.select(by, "row").distinct().join(told, [by, "row"], "left")
    return out.select(by, "row", *(F.coalesce(c, F.lit(v)).cast("int").alias(c) for c, v in (("member", -1), ("score", 0), ("phase", 0))))


def _in_rounds(scores: DataFrame, by: str, floor: int, margin: int) -> DataFrame:
    """The same by joins and aggregates, all groups advancing together. A round is a few of them over the cells that are free, and is written,
    so plans stay short; there are at most as many rounds as rows in a group, and few where rows have members of their own.
    """
    spark, path = scores.sparkSession, scratch(scores.sparkSession, "claims")
    count = iter(range(10**9))

    def keep(df: DataFrame) -> DataFrame:
        where = f"{path}/{next(count):05d}"
        df.write.parquet(where)
        return spark.read.schema(df.schema).parquet(where)

    every = keep(scores.groupBy(by, "row", "member").agg(F.max("score").cast("int").alias("score")))
    members = keep(every.groupBy(by).agg(F.count_distinct("member").alias("members")))
    cells, made = every, []

    for phase, least, lead in ((CONFIDENT, ACCEPT, 1), (RESIDUAL, floor, margin)):
        while True:
            taken = made[0] if made else None
            for more in made[1:]:
                taken = taken.union(more)
            gone = taken.groupBy(by).agg(F.count("*").alias("gone")) if made else None
            free = members.select(by, F.col("members").alias("free")) if gone is None else members.join(gone, by, "left").select(by, (F.col("members") - F.coalesce("gone", F.lit(0))).alias("free"))
            now = keep(_round(cells, free, by, least, lead).withColumn("phase", F.lit(phase)))
            if not now.limit(1).count():
                break
            made.append(now)
            cells = keep(cells.join(now.select(by, "row"), [by, "row"], "left_anti").join(now.select(by, "member"), [by, "member"], "left_anti"))
        if phase == CONFIDENT and made:
            claimed = taken.select(by, "member")
            again = every.where(F.col("score") >= ACCEPT).join(claimed, [by, "member"], "left_semi").join(taken.select(by, "row"), [by, "row"], "left_anti").select(by, "row").distinct()
            again = keep(again.withColumn("again", F.lit(True)))
            cells = keep(cells.join(again, [by, "row"], "left_anti"))
        elif phase == CONFIDENT:
            again = keep(every.select(by, "row", F.lit(True).alias("again")).limit(0))
    rows = every.select(by, "row").distinct().join(again, [by, "row"], "left")
    if made:
        rows = rows.join(taken, [by, "row"], "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("int") for c in ("member", "score", "phase")})
    phase = F.coalesce("phase", F.when(F.col("again"), DUPLICATE), F.lit(0))
    return rows.select(by, "row", F.coalesce("member", F.lit(-1)).alias("member"), F.coalesce("score", F.lit(0)).alias("score"), phase.cast("int").alias("phase"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
