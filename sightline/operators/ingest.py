"""Captures from readings to facts: the ranking and the roster, composed of the resolution operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import names
from sightline.operators import claims, creation, likely, nearest, resolve, sequences, store
from sightline.operators.nearest import Forms


def ranking(captures: DataFrame, members: DataFrame, reads: DataFrame, points: DataFrame, score: Callable[[Column, Column], Column] = names.likeness, forms: Forms = likely.forms) -> dict[str, DataFrame]:
    """A weekly ranking, read and attributed.

    captures: capture_id, status. members: capture_id, member_id, name. reads:
    capture_id, row, mode, text, one per way of reading a name. points: capture_id, row, text, confidence, retry_text, retry_confidence,
    late_text, late_confidence. Rows are numbered in rank order.

    The modes' scores are united; rows are assigned to the closed set of members; sure values that fall with the rank bound their neighbours;
    each row becomes a fact, a review or a duplicate; members of a complete, fully attributed capture without a row get 0.
    A review has the text that was read, and what the late retry read besides if it was tried in vain; one of a row without a member has all members of the capture as candidates, by score.
    forms: what of a name the score compares. Gives rows, facts, reviews, zeros and results (per capture). Everything joins on the capture, so captures are independent of each other.
    """
    pairs = reads.where("text <> ''").join(members, "capture_id").withColumn("score", score(F.col("text"), F.col("name")))
    best = pairs.groupBy("capture_id", "row", "member_id").agg(F.max("score").alias("score"))
    some = reads.where("text <> ''")
    tops = some.join(nearest.nearest(some, members, ["capture_id"], "text", "name", score, forms).select("capture_id", "text", "score").distinct(), ["capture_id", "text"])
    tops = tops.groupBy("capture_id", "row").agg(F.max_by("text", F.struct("score", -F.col("mode"))).alias("name_text"), F.max("score").alias("top"))
    # a row without any text has no pair, but it is a row of the matrix
    every = points.select("capture_id", "row").join(members.select("capture_id", "member_id"), "capture_id").join(best, ["capture_id", "row", "member_id"], "left")
    number = F.col("row").cast("int").alias("row")
    texts = points.select("capture_id", number).distinct().join(some.select("capture_id", number, "text").distinct(), ["capture_id", "row"], "left")
    assigned = claims.named(texts, members.select("capture_id", F.col("member_id").cast("int").alias("member"), "name"), "capture_id", "text", "name", score, forms)
    read = resolve.with_retry(F.col("text"), F.col("confidence"), F.col("retry_text"), F.col("retry_confidence"))
    rows = points.withColumn("_r", read).select("capture_id", "row", "_r.*", "late_text", "late_confidence").join(assigned, ["capture_id", "row"], "left").join(tops, ["capture_id", "row"], "left")
    rows = rows.fillna({"member": -1, "phase": 0, "score": 0, "top": 0})
    seeded = resolve.seeds(rows)
    sure = sequences.consistent(seeded.where("seeds").select("capture_id", "row", "points"), ["capture_id"], ["row"], "points").where("keep").select("capture_id", "row", F.lit(True).alias("known"))
    bounded = sequences.neighbour_bounds(seeded.join(sure, ["capture_id", "row"], "left").fillna({"known": False}), ["capture_id"], ["row"], "points", "known")
    told = resolve.attributed(bounded, "a", *(F.col(c) for c in ("phase", "top", "text", "confidence", "score", "lo", "hi", "late_text", "late_confidence", "retried")))
    vain = (F.col("a.reason") == "unparseable_points") & ~F.col("retried")
    raw = F.when(vain, F.concat(F.coalesce("text", F.lit("")), F.lit(" | retry: "), F.coalesce("late_text", F.lit("")))).otherwise(F.col("text"))
    out = told.select("capture_id", "row", "member", "phase", "name_text", raw.alias("raw"), F.col("a.outcome").alias("outcome"), F.col("a.value").alias("value"), F.col("a.confidence").alias("confidence"), F.col("a.reason").alias("reason"))
    lost = out.groupBy("capture_id").agg(F.count("*").alias("parsed"), F.count_if((F.col("member") < 0) & (F.col("phase") != resolve.DUPLICATE)).alias("unidentified"))
    state = captures.join(lost, "capture_id", "left").fillna({"parsed": 0, "unidentified": 0})
    taken = out.where("member >= 0").select("capture_id", F.col("member").cast("long").alias("member_id"))
    zeros = resolve.inferred_zeros(members.select("capture_id", "member_id"), taken, state)
    counters = resolve.result_counters(out, "capture_id")
    zeroed = zeros.groupBy("capture_id").agg(F.count("*").alias("zeroed"))
    results = state.join(counters, "capture_id", "left").join(zeroed, "capture_id", "left").na.fill(0)
    key = F.concat_ws("/", "capture_id", "row").alias("review_id")
    reviews = out.where("outcome = 'review'").select(key, "capture_id", "row", "reason", "raw", "confidence", "member")
    ranked = every.join(members, ["capture_id", "member_id"]).select(key, "member_id", "name", F.coalesce("score", F.lit(0)).cast("long").alias("score"))
    reviews = store.queued(reviews.drop("member"), ranked.join(reviews.where("member < 0").select("review_id"), "review_id", "left_semi"), "review_id").drop("review_id")
    return {"rows": out, "facts": out.where("outcome = 'fact'").select("capture_id", F.col("member").alias("member_id"), "value", "confidence"), "reviews": reviews, "zeros": zeros, "results": results}


def roster(members: DataFrame, rows: DataFrame, fields: DataFrame, stated: DataFrame) -> dict[str, DataFrame]:
    """A roster, read group by group.

    members: capture_id, group, member_id, name. rows: capture_id, group,
    ordinal, name, confidence, expected (the group's total where its header shows it). fields: capture_id, group, ordinal, and power, level,
    hours with their confidences power_conf, level_conf, hours_conf. stated: capture_id, stated (the alliance's own count, or null).

    Each row is matched, created or put to review; the fields of matched and created rows become facts or reviews; a capture is complete if every
    group's rows are as many as its header says, and all of them as many as the alliance says. Gives decisions, facts, reviews and captures.
    """
    by = ["capture_id", "group"]
    # columns of their own, as the tables may come from one
    members, rows, fields = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (members, rows, fields))
    decided = creation.decisions(rows, members, by)
    hit = decided.where("outcome in ('matched', 'created')").join(fields, [*by, "ordinal"])
    known = rows.select(*by, "ordinal", "name").join(members.withColumnRenamed("name", "_known"), by)
    # the score again, for the confidence of a match
    match = decided.where("outcome = 'matched'").join(known, [*by, "ordinal", "member_id"]).select(*by, "ordinal", (names.likeness("name", "_known") / 100).alias("match"))
    hit = hit.join(match, [*by, "ordinal"], "left").withColumn("match", F.coalesce("match", F.lit(1.0)))
    kinds = {"power": ("power", "power", "power_conf"), "level": ("level", "level", "level_conf"), "last_active_hours": ("last_active", "hours", "hours_conf")}
    each = resolve.field_outcomes(hit, [*by, "ordinal", "member_id"], "match", kinds)
    named = decided.where("outcome not in ('matched', 'created')").select(*by, "ordinal", F.col("outcome").alias("reason"))
    reviews = named.union(each.where("outcome <> 'fact'").select(*by, "ordinal", F.col("outcome").alias("reason")))
    first = F.min_by("expected", F.when(F.col("expected").isNotNull(), F.col("ordinal")))
    groups = rows.groupBy(*by).agg(F.count("*").alias("parsed"), first.alias("expected"))
    return {"decisions": decided, "facts": each.where("outcome = 'fact'").drop("outcome", "label"), "reviews": reviews, "captures": resolve.reconcile(groups, stated)}
