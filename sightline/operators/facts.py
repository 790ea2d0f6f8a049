"""Append-only facts: upserts guarded by confidence, supersession, reviews and aliases. All plain Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.streaming.runner import scratch

#: What makes two rows the same observation.
KEY = ["member_id", "metric", "period_key", "source", "observed_at"]


#: Types whose values an aggregate can change in place, so that it hashes instead of sorting.
PLAIN = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp")


def precedence(confidence: Column, arrival: Column) -> Column:
    """One number that orders readings: by confidence as a 32-bit float (0 to 1; none counts as 0), then the earlier arrival."""
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence.cast("float").cast("double"), F.lit(0.0))))
    ranked = (c.cast("decimal(19,18)") * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(19,0)")
    return (ranked * F.lit("10000000000000000000").cast("decimal(20,0)")).cast("decimal(38,0)") + (F.lit(2**63 - 1).cast("decimal(19,0)") - arrival.cast("decimal(19,0)"))


def upsert(facts: DataFrame, key: list[str] = KEY, arrival: str = "arrival") -> DataFrame:
    """The fact table after its rows arrived in order: of one key, the first with the strictly highest confidence (as a 32-bit float) holds; fact_id is the first arrival.

    One shuffle by key with a partial aggregate, so a hot key is combined before
    it travels. Columns of plain types are picked one by one by a number that orders readings, which hash aggregates can do; others as one struct, by sorting.
    """
    rest = [c for c in facts.columns if c not in key]
    counts = [F.min(arrival).alias("fact_id"), F.count("*").alias("reads")]
    if all(facts.schema[c].dataType.simpleString() in PLAIN for c in rest):
        ranked = facts.withColumn("_rank", precedence(F.col("confidence"), F.col(arrival)))
        return ranked.groupBy(*key).agg(*(F.max_by(c, "_rank").alias(c) for c in rest), *counts)
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col("confidence").cast("float"), F.lit(0.0).cast("float")), -F.col(arrival)))
    return facts.groupBy(*key).agg(best.alias("_b"), *counts).select(*key, "_b.*", "fact_id", "reads")


def live(facts: DataFrame, superseded: DataFrame, on: str = "fact_id") -> DataFrame:
    """Facts that no later fact supersedes; superseded is an edge table (fact_id, superseded_by)."""
    return facts.join(superseded.select(on), on, "left_anti")


def leaderboard(facts: DataFrame, by: list[str], value: str = "value", tie: str = "member_id") -> DataFrame:
    """Adds rank: place by value, largest first, then by tie, in each group.

    A few groups, or one value, can hold all rows, so rows are dealt by range of group, value and tie together, sorted within their range and numbered as they lie
    there. A row's rank is its number less that of its group's first in the range, and the group's rows in ranges before: a table of a row for each group and range.
    """
    spark = facts.sparkSession
    place = F.monotonically_increasing_id()  # the number of the range above 33 bits, that of the row below
    path = scratch(spark, "ranks")
    ordered = facts.orderBy(*by, F.desc(value), tie).withColumn("_at", place)
    ordered.write.parquet(path)
    dealt = spark.read.schema(ordered.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    counts = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_m"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col("_part").alias("_range"), "_first", before.alias("_before"))
    on = F.col("_part") == F.col("_range")
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    rank = (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int")
    return dealt.join(counts, on).select(*facts.columns, rank.alias("rank"))



def insert_absent(existing: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of new whose key is neither in existing nor earlier in new."""
    first = F.min_by(F.struct(*[c for c in new.columns if c not in key]), F.struct(*order))
    return new.join(existing.select(*key), key, "left_anti").groupBy(*key).agg(first.alias("_r")).select(*key, "_r.*")


def refresh(old: DataFrame, new: DataFrame, key: list[str], take: list[str], keep: list[str]) -> DataFrame:
    """Full-outer upsert: columns in take come from new where it has a value, columns in keep stay where old has one."""
    o, n = old.alias("o"), new.alias("n")
    out = o.join(n, key, "full_outer")
    return out.select(*key, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in take), *(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in keep))


def settle_reviews(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending reviews take the first decision (review_id, verdict, member_id, decided_at) on them; a settled one stays as it is."""
    first = decisions.groupBy("review_id").agg(F.min_by(F.struct("verdict", "member_id"), F.struct("decided_at", "verdict")).alias("d"))
    open_ = (F.col("status") == "pending") & F.col("d").isNotNull()
    return reviews.join(first, "review_id", "left").withColumn("resolved_member", F.when(open_ & (F.col("d.verdict") == "resolved"), F.col("d.member_id"))).withColumn("status", F.when(open_, F.col("d.verdict")).otherwise(F.col("status"))).drop("d")


def resolution_aliases(settled: DataFrame, aliases: DataFrame, normal: Column) -> DataFrame:
    """The aliases (member_id, alias, alias_normalized, source) that settling reviews adds: the raw text of each that was resolved just now (has a resolved_member), once for a member and normal form, of those not there yet.

    normal: the normal form of raw_text. The first review by number gives the spelling; a text that is empty in normal form is no alias. Rejected reviews teach nothing.
    """
    new = settled.where(F.col("resolved_member").isNotNull()).select(F.col("resolved_member").alias("member_id"), F.col("raw_text").alias("alias"), normal.alias("alias_normalized"), "review_id").where("alias_normalized <> ''")
    return insert_absent(aliases, new, ["member_id", "alias_normalized"], ["review_id"]).select("member_id", "alias", "alias_normalized", F.lit("review").alias("source"))


def gate(match: Column, read: Column, least: float = 0.80) -> Column:
    """Whether a value may be written: the weaker of its two confidences decides."""
    return F.least(match, read) >= least
