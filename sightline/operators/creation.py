"""Rows of a roster, in order, matched with members or creating them: as a fixed point of joins, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.names import ACCEPT, REVIEW
from sightline.operators.likely import likely
from sightline.operators.resolve import LEGIBLE
from sightline.streaming.runner import scratch


class _Tables:
    """Steps written to the shared folder, each read again by those after it, so no plan holds more than a step."""

    def __init__(self, spark):
        self.spark, self.path, self.count = spark, scratch(spark, "roster"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        where = f"{self.path}/{self.count:05d}"
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)


def _creators(edges: DataFrame, rows: DataFrame, by: list[str], tables: _Tables) -> DataFrame:
    """Of rows (by, ordinal) those that are like no earlier one of them: edges (by, ordinal, earlier) link rows that are alike.

    Each round keeps the rows without an earlier undecided one, and drops those that are like a kept one; the rounds are as many as the longest chain of rows each like the one before.
    """
    undecided, kept = rows, None
    while undecided.limit(1).count():
        ends = undecided.withColumnRenamed("ordinal", "earlier")
        held = edges.join(undecided, [*by, "ordinal"], "left_semi").join(ends, [*by, "earlier"], "left_semi")
        now = tables.keep(undecided.join(held.select(*by, "ordinal"), [*by, "ordinal"], "left_anti"))
        like = edges.join(now.withColumnRenamed("ordinal", "earlier"), [*by, "earlier"], "left_semi").select(*by, "ordinal")
        undecided = tables.keep(undecided.join(now, [*by, "ordinal"], "left_anti").join(like, [*by, "ordinal"], "left_anti"))
        kept = now if kept is None else kept.union(now)
    return rows.limit(0) if kept is None else kept


def decisions(rows: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """(by, ordinal, outcome, member_id) of the rows (by, ordinal, name, confidence, expected) of each group against its members (by, member_id, name).

    What resolve.roster_rows says of each group, row by row: blank names are unreadable; the accepted score is a match, with the member known for longer of equals; the review score is ambiguous; below,
    a weak read is queued, and else a member is created while the members that rows have used are fewer than the group's total (the first that its rows show). Created members are candidates for the
    rows after, and are numbered from -1 down.

    First creation without the total: a row that no member is like creates if it is like no earlier creating row. Then the members are put in the order of their first use; where that reaches
    the total, creation ends, and every row is told against the members that were there before it.
    """
    tables = _Tables(rows.sparkSession)
    all_rows = tables.keep(rows.select(*by, "ordinal", "name", "confidence", "expected").withColumn("blank", F.length(F.regexp_replace(F.coalesce("name", F.lit("")), r"^\s+|\s+\z", "")) == 0))
    known = tables.keep(members.select(*by, F.col("member_id").cast("long").alias("member_id"), "name"))
    first = F.min_by("expected", F.when(F.col("expected").isNotNull(), F.col("ordinal")))
    totals = tables.keep(all_rows.groupBy(*by).agg(first.alias("total")))
    named = all_rows.where("not blank")
    # likenesses that matter: with known members, and with earlier rows
    with_known = likely(named.select(*by, F.col("name").alias("read")), known, by, "read", "name", least=REVIEW)
    with_known = tables.keep(with_known.withColumnRenamed("read", "name"))
    best_known = with_known.groupBy(*by, "name").agg(F.max("score").alias("known"))
    open_rows = named.join(best_known, [*by, "name"], "left_anti").where(F.col("confidence") >= LEGIBLE).join(totals.where("total is not null"), by, "left_semi")
    open_rows = tables.keep(open_rows.select(*by, "ordinal", "name"))
    alike = likely(named.select(*by, F.col("name").alias("read")), open_rows, by, "read", "name", member="ordinal", least=REVIEW)
    alike = tables.keep(alike.withColumnRenamed("ordinal", "earlier").join(named.select(*by, "ordinal", F.col("name").alias("read")), [*by, "read"]).where("earlier < ordinal").select(*by, "ordinal", "earlier", "score"))
    creators = tables.keep(_creators(alike, open_rows.select(*by, "ordinal"), by, tables))

    def told(made: DataFrame) -> DataFrame:
        """Each named row with the best of the members that are there before it: struct(score, since, member), since being 0 for known members and then the order of creation."""
        old = named.join(with_known, [*by, "name"]).select(*by, "ordinal", "score", F.lit(0).cast("long").alias("since"), "member_id")
        new = alike.join(made.select(*by, F.col("ordinal").alias("earlier"), "member_id"), [*by, "earlier"]).select(*by, "ordinal", "score", (-F.col("member_id")).alias("since"), "member_id")
        # of known members with equal scores the one that comes first by number
        order = F.struct("score", (-F.col("since")).alias("s"), F.when(F.col("since") == 0, -F.col("member_id")).otherwise(F.lit(0)).alias("m"))
        return old.union(new).groupBy(*by, "ordinal").agg(F.max_by(F.struct("score", "member_id"), order).alias("best"))

    number = (-F.row_number().over(Window.partitionBy(*by).orderBy("ordinal"))).cast("long")
    every = tables.keep(creators.withColumn("member_id", number))
    matched = told(every).where(F.col("best.score") >= ACCEPT).select(*by, "ordinal", "best.member_id")
    uses = matched.union(every.select(*by, "ordinal", "member_id")).groupBy(*by, "member_id").agg(F.min("ordinal").alias("ordinal"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("ordinal", "member_id"))
    ends = uses.withColumn("place", place).join(totals, by).where(F.col("place") == F.col("total")).select(*by, F.col("ordinal").alias("last"))
    allowed = every.join(totals, by).join(ends, by, "left").where((F.col("total") > 0) & (F.col("last").isNull() | (F.col("ordinal") <= F.col("last"))))
    made = tables.keep(allowed.select(*by, "ordinal", "member_id"))
    out = all_rows.join(tables.keep(told(made)), [*by, "ordinal"], "left").join(made.withColumnRenamed("member_id", "new"), [*by, "ordinal"], "left").join(totals, by)
    score = F.coalesce("best.score", F.lit(0))
    outcome = F.when(F.col("blank"), "unreadable_name").when(score >= ACCEPT, "matched").when(score >= REVIEW, "ambiguous_name_match").when(F.col("confidence") < LEGIBLE, "low_confidence_name")
    outcome = outcome.when(F.col("total").isNull(), "no_confident_match_group_count_unknown").when(F.col("new").isNotNull(), "created").otherwise("no_confident_match_group_full")
    out = out.withColumn("outcome", outcome)
    member = F.when(F.col("outcome") == "matched", F.col("best.member_id")).when(F.col("outcome") == "created", F.col("new"))
    return out.select(*by, F.col("ordinal").cast("long").alias("ordinal"), "outcome", member.alias("member_id"))
