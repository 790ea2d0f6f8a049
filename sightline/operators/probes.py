"""Probes of the resolver: decoys, shuffled truth, parameter grids and what first readings would win."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.names import PAIRS
from sightline.operators import claims, nearest
from sightline.operators.nearest import Forms
from sightline.operators.resolve import DUPLICATE, assign


def decoy(name: Column) -> Column:
    """A name with its first character that looks like another exchanged for that one; unchanged without any."""
    swaps = dict(p for a, b in PAIRS for p in ((a, b), (b, a)))
    place = F.regexp_instr(F.lower(name), F.lit("[" + "".join(sorted(swaps)) + "]"))
    to = F.translate(F.lower(F.substr(name, place, F.lit(1))), "".join(swaps), "".join(swaps.values()))
    return F.when(place > 0, F.concat(F.substr(name, F.lit(1), place - 1), to, F.substr(name, place + 1))).otherwise(name)


def rotated(df: DataFrame, by: list[str], order: str, label: str) -> DataFrame:
    """Truth shuffled by one place in each group: every row gets the next one's label, the last the first's. What still scores well by it, scores by chance."""
    w = Window.partitionBy(*by).orderBy(order)
    first = F.first(label).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(label, F.coalesce(F.lead(label).over(w), first))


def grid(pairs: DataFrame, truth: DataFrame, by: str, floors: list[int], margins: list[int]) -> DataFrame:
    """(floor, margin, correct, wrong, unassigned, duplicate) of closed-set assignment for each pair of parameters, and of plain thresholds as margin -1.

    pairs: by, row, member, score; truth: by, row, member. Each capture's matrix is assigned once for each setting, in one task.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows, members = np.unique(left["row"]), np.unique(left["member"])
        matrix = np.zeros((len(rows), len(members)), np.int64)
        np.maximum.at(matrix, (np.searchsorted(rows, left["row"]), np.searchsorted(members, left["member"])), left["score"].to_numpy())
        want = right.set_index("row")["member"].reindex(rows, fill_value=-1).to_numpy()
        out = []
        for floor in floors:
            for margin in (-1, *margins):
                if margin < 0:
                    got = np.where(matrix.max(1) >= floor, members[matrix.argmax(1)], -1)
                    phase = np.zeros(len(rows))
                else:
                    at, _, phase = assign(matrix, floor, margin)
                    got = np.where(at < 0, -1, members[at])
                dup = phase == DUPLICATE
                out.append((floor, margin, int(((got >= 0) & (got == want)).sum()), int(((got >= 0) & (got != want)).sum()), int(((got < 0) & ~dup).sum()), int(dup.sum())))
        return pd.DataFrame(out, columns=["floor", "margin", "correct", "wrong", "unassigned", "duplicate"])

    # columns of their own, as both sides may come from one table
    pairs, truth = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (pairs, truth))
    counts = "correct long, wrong long, unassigned long, duplicate long"
    each = pairs.groupBy(by).cogroup(truth.groupBy(by)).applyInPandas(run, f"floor int, margin int, {counts}")
    return each.groupBy("floor", "margin").agg(*(F.sum(c).alias(c) for c in ("correct", "wrong", "unassigned", "duplicate")))


def grid_of_names(rows: DataFrame, members: DataFrame, truth: DataFrame, by: str, text: str, name: str, score: Callable, forms: Forms, floors: list[int], margins: list[int]) -> DataFrame:
    """grid of rows (by, row, text) and members (by, member, name), each row with one text, without all pairs.

    Claims of the accepted score are the same in every setting, so they are made once, and thresholds need a row's nearest members alone. What is left of a capture is assigned once for each setting, in one task.
    """
    keep = nearest._keeper(rows, "grid")
    truth = keep(truth.select(by, "row", F.col("member").alias("_want")))
    told, left, free = claims.confident(rows, members, by, text, name, score, forms)
    cells = claims.remaining(left, free, by, text, name, min(floors) - max(margins) + 1, score)
    rest = grid(keep(cells), truth.join(left.select(by, "row"), [by, "row"], "left_semi").withColumnRenamed("_want", "member"), by, floors, margins).where("margin > 0").select("floor", "margin", "correct", "wrong")
    right, some = F.coalesce(F.col("member") == F.col("_want"), F.lit(False)), F.col("member") >= 0
    sure = told.join(truth, [by, "row"], "left").agg(F.count_if(some & right).alias("_right"), F.count_if(some & ~right).alias("_wrong"), F.count_if(F.col("phase") == DUPLICATE).alias("duplicate"))
    tops = nearest.nearest(rows, members, [by], text, name, score, forms).join(members, [by, name]).groupBy(by, text).agg(F.min("member").alias("member"), F.max("score").alias("score"))
    best = rows.join(tops, [by, text]).join(truth, [by, "row"], "left").groupBy("score").agg(F.count_if(right).alias("correct"), F.count_if(~right).alias("wrong"))
    spark = rows.sparkSession
    plain = spark.createDataFrame([(f,) for f in floors], "floor int").join(F.broadcast(best), F.col("score") >= F.col("floor"), "left")  # a row for each score
    plain = plain.groupBy("floor").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("correct", "wrong"))).select("floor", F.lit(-1).alias("margin"), "correct", "wrong", F.lit(0).cast("long").alias("duplicate"))
    settings = spark.createDataFrame([(f, m) for f in floors for m in margins], "floor int, margin int").join(rest, ["floor", "margin"], "left").crossJoin(F.broadcast(sure))  # one row
    settled = settings.select("floor", "margin", (F.coalesce("correct", F.lit(0)) + F.col("_right")).alias("correct"), (F.coalesce("wrong", F.lit(0)) + F.col("_wrong")).alias("wrong"), "duplicate")
    total = rows.select(by, "row").distinct().agg(F.count("*").alias("_n"))
    out = settled.unionByName(plain).crossJoin(F.broadcast(total))  # one row
    return out.select("floor", "margin", "correct", "wrong", (F.col("_n") - F.col("correct") - F.col("wrong") - F.col("duplicate")).alias("unassigned"), "duplicate")


def points_probe(reads: DataFrame, by: list[str], least: float) -> DataFrame:
    """Readings of a number by how good they are: per config the counts of empty, unparseable, exact, close (1 %), off, weak and retried ones."""
    close = F.abs(F.col("points") - F.col("want")) / F.col("want") <= 0.01
    kind = F.when(F.col("text") == "", "empty").when(F.col("points").isNull(), "unparseable").when(F.col("points") == F.col("want"), "exact").when(close, "close").otherwise("off")
    n = lambda k: F.count_if(F.col("_k") == k).alias(k)
    return reads.withColumn("_k", kind).groupBy(*by).agg(*(n(k) for k in ("empty", "unparseable", "exact", "close", "off")), F.count_if((F.col("confidence") < least) & (F.col("text") != "")).alias("weak"), F.count_if("retried").alias("retried"))


def best_points(reads: DataFrame, by: list[str]) -> DataFrame:
    """Per rank the best reading: exact before close before off before none, then the smallest relative error, then the smallest text."""
    error = F.abs(F.col("points") - F.col("want")) / F.col("want")
    tier = F.when(error == 0, 0).when(error <= 0.01, 1).when(error.isNotNull(), 2).otherwise(3)
    return reads.groupBy(*by).agg(F.min_by(F.struct("text", tier.alias("tier")), F.struct(tier, error, "text")).alias("_b")).select(*by, "_b.*")


def first_wins(reads: DataFrame, by: list[str], order: list[str], floor: float, repeats: int) -> DataFrame:
    """Per true name the reading that would have created its member: the first that is sure enough, or the one that says the same for the k-th time; and its verdict."""
    seen = Window.partitionBy(*by, "normal").orderBy(*order)
    told = reads.withColumn("_k", F.row_number().over(seen)).where((F.col("confidence") >= floor) | (F.col("_k") >= repeats))
    first = told.groupBy(*by).agg(F.min_by(F.struct("normal", "score"), F.struct(*order)).alias("_f"))
    out = reads.select(*by).distinct().join(first, by, "left")
    return out.select(*by, F.col("_f.normal").alias("claimed"), F.when(F.col("_f").isNull(), "never created").when(F.col("_f.score") >= 92, "covered").otherwise("orphaned").alias("verdict"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
