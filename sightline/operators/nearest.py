"""Texts within a few edits of each other, and each text's nearest ones, without comparing all pairs: two such texts are equal once a few characters of each are left out."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import names
from sightline.operators import likely
from sightline.streaming.runner import scratch

#: Edits that are looked for by leaving characters out; texts whose nearest may be further away are compared with all of their block.
EDITS = 2
#: Gives distinct (block, text, form) of rows: what of a text is compared. A score falls by the share of edits between forms, or faster.
Forms = Callable[[DataFrame, list[str], str], DataFrame]


def as_written(rows: DataFrame, block: list[str], text: str) -> DataFrame:
    """The text itself is its one form, as names.edit_ratio compares it."""
    return rows.where(F.col(text).isNotNull()).select(*block, text, F.col(text).alias("form")).distinct()


def _left_out(text: Column, k: int) -> Column:
    """array<string>: what is left of a text without k of its characters, each once."""
    out = F.array(text)
    for _ in range(k):
        each = lambda s: F.when(F.length(s) < 1, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1))))
        out = F.array_distinct(F.flatten(F.transform(out, each)))
    return out


def _key(d: int, v: Column) -> Column:
    return F.struct(F.lit(d).alias("d"), F.xxhash64(v).alias("v"))


def _lengths(forms: DataFrame) -> list[int]:
    return [r[0] for r in forms.select(F.length("form")).distinct().collect()]  # as many rows as there are lengths


def within(left: DataFrame, right: DataFrame, block: list[str], x: str, y: str, edits: int) -> DataFrame:
    """Distinct (block, x, y) of forms (block, x, form) and (block, y, form) that some form of each brings within so many edits; none is missing.

    Of two forms of m and n characters, m >= n, that many edits apart or fewer, the first without `edits` and the second without `edits` - m + n of its characters share a text.
    """
    ms, ns = _lengths(left), _lengths(right)

    def keyed(forms: DataFrame, text: str, mine: list[int], others: list[int], sign: int) -> DataFrame:
        shares = [F.array().cast("array<struct<d:int,v:bigint>>")]
        for d in range(-edits, edits + 1):  # by how much the left form is longer
            fit = [m for m in mine if m - sign * d in others]
            if fit:
                keys = F.transform(_left_out(F.col("form"), edits - max(0, -sign * d)), partial(_key, d))
                shares.append(F.when(F.length("form").isin(fit), keys).otherwise(shares[0]))
        return forms.select(*block, text, F.col("form").alias(f"_{text}"), F.explode(F.flatten(F.array(*shares))).alias("_k")).select(*block, text, f"_{text}", "_k.*")

    a, b = keyed(left, x, ms, ns, 1), keyed(right, y, ns, ms, -1)
    met = a.hint("merge").join(b, [*block, "d", "v"])
    return met.where(F.levenshtein(f"_{x}", f"_{y}") <= edits).select(*block, x, y).distinct()


def _bound(m: Column, longest: int, edits: int) -> Column:
    """The best score, from 0 to 100, of a form of m characters with one that is more than so many edits away and no longer than `longest`."""
    whole = F.greatest(m, F.least(F.lit(longest), m + edits + 1), F.lit(1))
    return F.greatest(F.lit(0), F.floor(100 * (whole - edits - 1) / whole))


def _keeper(df: DataFrame, name: str) -> Callable[[DataFrame], DataFrame]:
    """Writes a step's table and gives it back as read, so that plans stay short."""
    spark, path, count = df.sparkSession, scratch(df.sparkSession, name), iter(range(10**9))

    def keep(df: DataFrame) -> DataFrame:
        where = f"{path}/{next(count):05d}"
        df.write.parquet(where)
        return spark.read.schema(df.schema).parquet(where)

    return keep


def reaching(left: DataFrame, right: DataFrame, block: list[str], x: str, y: str, least: int, score: Callable = names.edit_ratio, forms: Forms = as_written) -> DataFrame:
    """(block, x, y, score) of all distinct texts of a block whose score is `least` or more.

    Forms short enough that such a score leaves EDITS edits at the most meet by what is left of them; pairs with a longer form are compared if their lengths fit.
    """
    a, b = forms(left, block, x), forms(right, block, y)
    room = 100 - least
    longest = max([m for m in {*_lengths(a), *_lengths(b)} if m * room // 100 <= EDITS], default=0)
    pairs = within(a.where(F.length("form") <= longest), b.where(F.length("form") <= longest), block, x, y, longest * room // 100)
    sides = [f.select(*block, t, F.length("form").alias(n)) for f, t, n in ((a, x, "m"), (b, y, "n"))]
    fits = 100 * F.abs(F.col("m") - F.col("n")) <= F.greatest("m", "n") * room
    for mine, other in ((F.col("m") > longest, None), (F.col("n") > longest, F.col("m") <= longest)):
        far = (sides[0].where(mine).join(sides[1], block) if other is None else sides[0].where(other).join(sides[1].where(mine), block)).where(fits)
        pairs = pairs.union(far.select(*block, x, y))
    return pairs.distinct().withColumn("score", score(x, y)).where(F.col("score") >= least)


def nearest(left: DataFrame, right: DataFrame, block: list[str], x: str, y: str, score: Callable = names.edit_ratio, forms: Forms = as_written, least: int = 0) -> DataFrame:
    """(block, x, y, score): for each distinct text x of left all texts y of right in its block that have its highest score, if that is `least` or more.

    Texts within no edit are looked for first, then within one, within EDITS; a text is done once it has a score that nothing further away can reach, or if nothing further away can reach `least`. What is left is compared
    with its whole block, each distinct pair once.
    """
    keep = _keeper(left, "nearest")
    a, b = keep(forms(left, block, x)), keep(forms(right, block, y))
    longest = max(_lengths(b), default=0)
    every = left.where(F.col(x).isNotNull()).select(*block, x).distinct()
    rest = keep(every.join(a.groupBy(*block, x).agg(F.max(F.length("form")).alias("m")), [*block, x], "left").fillna({"m": 0}))
    tops = []

    def top(scored: DataFrame) -> DataFrame:
        scored = scored.where(F.col("score") >= least)
        return scored.join(scored.groupBy(*block, x).agg(F.max("score").alias("score")), [*block, x, "score"]).select(*block, x, y, "score")

    for edits in range(EDITS + 1):
        bound = _bound(F.col("m"), longest, edits)
        best = keep(top(within(a.join(rest.select(*block, x), [*block, x], "left_semi"), b, block, x, y, edits).withColumn("score", score(x, y))))
        tried = rest.join(best.groupBy(*block, x).agg(F.max("score").alias("_s")), [*block, x], "left")
        done = (bound < F.coalesce("_s", F.lit(-1))) | (bound < least)
        tops.append(best.join(tried.where(done).select(*block, x), [*block, x], "left_semi"))
        rest = keep(tried.where(~done).select(*block, x, "m"))
        if not rest.limit(1).count():
            break
    else:
        if forms is likely.forms and least <= names.REVIEW:
            met = likely.paired(rest.withColumnRenamed(x, "_read"), right.withColumnRenamed(y, "_name"), block, "_read", "_name", names.REVIEW).select(*block, F.col("_read").alias(x), F.col("_name").alias(y))
            found = keep(top(met.withColumn("score", score(x, y)).where(F.col("score") >= names.REVIEW)))
            tops.append(found)
            rest = rest.join(found.select(*block, x).distinct(), [*block, x], "left_anti")
        tops.append(top(rest.select(*block, x).join(right.where(F.col(y).isNotNull()).select(*block, y).distinct(), block).withColumn("score", score(x, y))))
    out = tops[0]
    for more in tops[1:]:
        out = out.union(more)
    return out


def closest(members: DataFrame, by: list[str], name: str, key: str) -> DataFrame:
    """Per group the two members whose names are most alike by names.edit_ratio, the first of equals: (by, a, b, score), a < b.

    The distance grows from none to EDITS; a group is done once it has a pair that no more distant one can equal. Of equal names the two lowest members are enough.
    """
    keep = _keeper(members, "closest")
    rows = members.where(F.col(key).isNotNull() & F.col(name).isNotNull()).select(*by, F.col(name).alias("_n"), F.col(key).alias("a")).distinct()
    lowest = F.slice(F.array_sort(F.collect_set("a")), 1, 2)
    # a partial aggregate first, so that a name that is everywhere isn't one list
    few = rows.groupBy(*by, "_n", F.pmod(F.xxhash64("a"), F.lit(64)).alias("_p")).agg(lowest.alias("_l")).select(*by, "_n", F.explode("_l").alias("a")).groupBy(*by, "_n").agg(lowest.alias("_l"))
    rows = keep(few.select(*by, "_n", F.explode("_l").alias("a")))
    left = keep(rows.groupBy(*by).agg(F.max(F.length("_n")).alias("m")))
    others = rows.select(*by, F.col("_n").alias("_o"), F.col("a").alias("b"))
    best = F.max_by(F.struct("a", "b", "score"), F.struct("score", -F.col("a"), -F.col("b"))).alias("_p")
    out = None
    for edits in (*range(EDITS + 1), None):
        own = rows.join(left.select(*by), by, "left_semi").select(*by, "_n").distinct()
        twin = own.withColumnRenamed("_n", "_o")
        met = own.join(twin, by) if edits is None else within(as_written(own, by, "_n"), as_written(twin, by, "_o"), by, "_n", "_o", edits)
        named = met.withColumn("score", names.edit_ratio("_n", "_o")).join(rows, [*by, "_n"]).join(others, [*by, "_o"]).where("a < b")
        found = named.groupBy(*by).agg(best).select(*by, "_p.*")
        if edits is not None:
            found = found.join(left, by).where(_bound(F.col("m"), 0, edits) < F.col("score")).drop("m")
        found = keep(found)
        out = found if out is None else out.union(found)
        if edits is not None:
            left = left.join(found.select(*by), by, "left_anti")
            if not left.limit(1).count():
                break
    return out
