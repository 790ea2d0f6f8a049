"""Pairs of names alike enough, without comparing all pairs: an exact join by pieces that two such names must share."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions import names
from sightline.functions.names import PAIRS, REVIEW
from sightline.functions.names import _forms as compared

#: The join needs likenesses above one half: below, two names alike enough need not share anything.
LEAST = 51
#: Likenesses that the search for the closest pair tries in turn.
STEPS = (92, 75, 60, LEAST)


def classes(pairs: list[str] = PAIRS) -> tuple[str, str]:
    """Characters that a chain of look-alikes connects, and the one that stands for each."""
    of: dict[str, str] = {}
    for x, y in pairs:
        a, b = of.setdefault(x, x), of.setdefault(y, y)
        for c, r in of.items():
            if r in (a, b):
                of[c] = min(a, b)
    return "".join(of), "".join(of.values())


@F.pandas_udf(T.ArrayType(T.StringType()))
def _forms(s: pd.Series) -> pd.Series:
    # by its own name: the module as a whole can't travel to the workers
    return s.map(lambda x: list(compared(x)[:4]))


def forms(rows: DataFrame, block: list[str], name: str) -> DataFrame:
    """Distinct (block, name, form): the forms of a name that are compared, with look-alikes made one; most names have one alone. Empty forms have no row, nor has a null or empty name."""
    each = rows.where(F.col(name).isNotNull()).select(*block, name).distinct().withColumn("_f", _forms(name))
    plain = F.array_distinct(F.transform("_f", lambda f: F.translate(f, *classes())))
    return each.select(*block, name, F.explode(plain).alias("form")).where("form <> ''")


def _pieces(least: int) -> Column:
    """array<struct<start, piece>>: a form of m characters cut in one piece more than edits fit into any name that is alike enough, so one piece at least stays whole."""
    cuts = f"(length(form) * {100 - least} div {least} + 1)"
    start = lambda i: f"cast({i} * length(form) div {cuts} as int)"
    return F.expr(f"transform(sequence(0, cast({cuts} as int) - 1), i -> struct({start('i')} as start, substring(form, {start('i')} + 1, {start('(i + 1)')} - {start('i')}) as piece))")


def _parts(least: int) -> Column:
    """array<struct<start, piece>>: all substrings of a form that are as long as a piece of a form alike enough can be."""
    cuts = f"(m * {100 - least} div {least} + 1)"
    reach = f"cast(length(form) * {100 - least} div {least} as int)"
    sizes = f"array_distinct(flatten(transform(sequence(greatest(1, length(form) - {reach}), length(form) + {reach}), m -> array(cast(m div {cuts} as int), cast((m + {cuts} - 1) div {cuts} as int)))))"
    return F.expr(f"flatten(transform(filter({sizes}, n -> n <= length(form)), n -> transform(sequence(0, length(form) - n), p -> struct(p as start, substring(form, p + 1, n) as piece))))")


def paired(reads: DataFrame, members: DataFrame, block: list[str], read: str, name: str, least: int = REVIEW) -> DataFrame:
    """Distinct (block, read, name) that can reach `least`: none that does is missing.

    An exchange of look-alikes costs less than an edit but leaves the form with look-alikes made one as it is, so a likeness of `least` allows a share of 100 - least
    edits, whole ones, in the longer form. Forms meet where they share a piece, about where it stands; then their lengths and their distance must fit.
    """
    if least < LEAST:
        raise ValueError(f"the join needs a likeness of {LEAST} or more")
    x = forms(reads, block, read).withColumn("m", F.length("form")).select(*block, read, F.col("form").alias("x"), "m", F.explode(_parts(least)).alias("p")).select(*block, read, "x", "m", F.col("p.start").alias("at"), F.col("p.piece").alias("piece"))
    y = forms(members, block, name).select(*block, name, F.col("form").alias("y"), F.length("form").alias("n"), F.explode(_pieces(least)).alias("p")).select(*block, name, "y", "n", F.col("p.start").alias("start"), F.col("p.piece").alias("piece"))
    room = lambda c: F.lit(100) * c <= F.greatest("m", "n") * (100 - least)
    near = x.join(y, [*block, "piece"]).where(room(F.abs(F.col("m") - F.col("n"))) & room(F.abs(F.col("at") - F.col("start"))))
    near = near.select(*block, read, name, "x", "y", "m", "n").distinct().where(room(F.levenshtein("x", "y")))
    return near.select(*block, read, name).distinct()


def likely(reads: DataFrame, members: DataFrame, block: list[str], read: str, name: str, member: str = "member_id", aliases: str | None = None, least: int = REVIEW) -> DataFrame:
    """(block, read, member, score) of every read and member of its block whose likeness is `least` or more: the best over the member's name and aliases (an array column).

    Distinct names are compared once; the pairs that are scored are those that `paired` leaves.
    """
    every = members.select(*block, member, F.explode(F.array_append(F.coalesce(aliases, F.array().cast("array<string>")), F.col(name)) if aliases else F.array(name)).alias(name))
    scored = paired(reads, every, block, read, name, least).withColumn("score", names.likeness(read, name)).where(F.col("score") >= least)
    return scored.join(every.distinct(), [*block, name]).groupBy(*block, read, member).agg(F.max("score").alias("score"))


def closest_names(members: DataFrame, by: list[str], name: str, key: str) -> DataFrame:
    """Per group the two members whose names are most alike, the first of equals: (by, a, b, score), a < b.

    The bound falls from likeness to likeness; a group is done once it has a pair, as all pairs at or above the bound are then known. Only groups without any above one half, of
    names that are all unlike, are compared pair by pair.
    """
    rows = members.select(*by, F.col(key).alias("a"), F.col(name).alias("_n")).where("a is not null")
    out, left = None, rows.select(*by).distinct()
    best = F.max_by(F.struct("a", "b", "score"), F.struct("score", -F.col("a"), -F.col("b"))).alias("_p")

    def top(pairs: DataFrame) -> DataFrame:
        named = pairs.join(rows, [*by, "_n"]).join(rows.withColumnRenamed("_n", "_o").withColumnRenamed("a", "b"), [*by, "_o"]).where("a < b")
        return named.groupBy(*by).agg(best).select(*by, "_p.*")

    for least in (*STEPS, 0):
        own = rows.join(left, by, "left_semi")
        others = own.withColumnRenamed("_n", "_o").select(*by, "_o")
        met = paired(own, others, by, "_n", "_o", least) if least else own.select(*by, "_n").distinct().join(others.distinct(), by)
        found = top(met.withColumn("score", names.likeness("_n", "_o")).where(F.col("score") >= least)).persist()
        out = found if out is None else out.union(found)
        left = left.join(found.select(*by), by, "left_anti")
        if not left.limit(1).count():
            break
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
