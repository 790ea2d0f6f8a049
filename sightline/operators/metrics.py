"""Participation metrics over facts (member_id, day, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weekly(facts: DataFrame, member: str, ts: str, value: str, week) -> DataFrame:
    return facts.groupBy(member, week.alias("period_key")).agg(F.round(F.sum(value), 2).alias("total"), F.count("*").alias("n"))


def share_of_days(facts: DataFrame, member: str, day: str, passed) -> DataFrame:
    """Days on which a fact passed, over all days of the table's span."""
    span = facts.agg((F.datediff(F.max(day), F.min(day)) + 1).alias("days"))
    return facts.groupBy(member).agg(F.count_distinct(F.when(passed, F.col(day))).alias("days_passed")).join(F.broadcast(span)).withColumn("share", F.round(F.col("days_passed") / F.col("days"), 6)).drop("days")


def growth(totals: DataFrame, member: str, group: str, period: str, value: str) -> DataFrame:
    """Change to the member's period before, and the distance to the group's median change."""
    delta = totals.withColumn("delta", F.round(F.col(value) - F.lag(value).over(Window.partitionBy(member).orderBy(period)), 2))
    mid = quantile(delta, [group, period], "delta", 0.5).select(group, period, F.round("quantile", 4).alias("median_delta"))
    return delta.join(mid, [group, period]).withColumn("versus_group", F.round(F.col("delta") - F.col("median_delta"), 4))


def streaks(days: DataFrame, member: str, day: str) -> DataFrame:
    """Longest run of consecutive days, and the last one's length and end. days holds distinct (member, day)."""
    w = Window.partitionBy(member).orderBy(day)
    island = days.withColumn("_g", F.date_sub(F.col(day), F.row_number().over(w)))
    runs = island.groupBy(member, "_g").agg(F.count("*").alias("length"), F.max(day).alias("last"))
    return runs.groupBy(member).agg(F.max("length").alias("longest"), F.max_by("length", "last").alias("current"), F.max("last").alias("last_day"))


def inactivity(last_seen: DataFrame, days_since: str) -> DataFrame:
    """Tiers at 7, 14 and 21 days."""
    d = F.col(days_since)
    return last_seen.withColumn("tier", F.when(d >= 21, 3).when(d >= 14, 2).when(d >= 7, 1).otherwise(0))


def composite(df: DataFrame, weights: dict[str, float], name: str = "composite") -> DataFrame:
    """Weighted sum of component columns, which stay beside it."""
    total = sum((F.col(c) * F.lit(w) for c, w in weights.items()), F.lit(0.0))
    return df.withColumn(name, F.round(total, 6))


#: Values of a group that the exact aggregate may hold: some 50 MB.
WHOLE = 1_000_000


def quantile(df: DataFrame, by: list[str], value: str, q: float, slack: float = 0.004) -> DataFrame:
    """(by, quantile): the exact quantile of each group, interpolated between neighbours; null without values.

    Approximate quantiles a little below and above, whose error is bounded by a
    quarter of the slack, bracket it; what lies below is counted, and only the values within the bracket are put in order. So no task holds a whole group.
    Where no group has more than WHOLE values, as their count shows, the exact aggregate of Spark gives the same in one step.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    if not rows.groupBy(*by).count().where(F.col("count") > WHOLE).limit(1).count():
        return df.groupBy(*by).agg(F.percentile(value, q).alias("quantile"))
    ends = F.percentile_approx("_v", F.array(F.lit(max(0.0, q - slack)), F.lit(min(1.0, q + slack))), int(4 / slack))
    bracket = rows.groupBy(*by).agg(ends.alias("_e"), F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    # in a small group the bracket is the whole group: there a neighbour can be further away than the slack
    small = F.col("_n") < int(8 / slack)
    bracket = bracket.select(*by, "_n", F.when(small, F.col("_least")).otherwise(F.col("_e")[0]).alias("_lo"), F.when(small, F.col("_most")).otherwise(F.col("_e")[1]).alias("_hi"))
    placed = rows.join(bracket, by)
    below = placed.groupBy(*by).agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.first("_n").alias("_n"))
    inside = placed.where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy(*by, "_v").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    at = inside.withColumn("_upto", upto).join(below, by).withColumn("_k", (F.col("_n") - 1) * F.lit(q))
    first, last = F.col("_below") + F.col("_upto") - F.col("_m"), F.col("_below") + F.col("_upto") - 1
    one = lambda k: F.max(F.when(k.between(first, last), F.col("_v")))
    two = at.groupBy(*by).agg(one(F.floor("_k")).alias("_a"), one(F.ceil("_k")).alias("_b"), F.first("_k").alias("_k"))
    exact = two.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_k") - F.floor("_k"))).alias("quantile"))
    return df.select(*by).distinct().join(exact, by, "left")


def lowest_decile(df: DataFrame, by: str, value: str, then: list) -> DataFrame:
    """Rows at or below their group's tenth percentile, in the given order."""
    cut = quantile(df, [by], value, 0.1).withColumnRenamed("quantile", "_cut")
    return df.join(cut, by).where(F.col(value) <= F.col("_cut")).drop("_cut").orderBy(*then)


def ratio(facts: DataFrame, member: str, of: Column, done: Column, base: str, name: str) -> DataFrame:
    """Per member the rows that count and the share of them that is done, 0 without any."""
    n = F.count_if(of)
    return facts.groupBy(member).agg(n.alias(base), F.round(F.coalesce(F.try_divide(F.count_if(of & done), n), F.lit(0.0)), 6).alias(name))


def decay(age: Column, days: float = 7.0) -> Column:
    """Weight of something last seen some days ago; the time constant is a choice of this library."""
    return F.exp(-age / F.lit(days))
