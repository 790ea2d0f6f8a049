"""Classifier evaluation: confusion, accuracy, separation of scores, best of several readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import names
from sightline.functions.names import REVIEW
from sightline.operators import likely

NONE, NEGATIVE = "<none>", "_none"


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, predicted, n), an empty prediction being NONE."""
    return df.groupBy(F.col(label).alias("label"), F.coalesce(F.nullif(F.col(predicted), F.lit("")), F.lit(NONE)).alias("predicted")).agg(F.count("*").alias("n"))


def is_correct(label: Column, predicted: Column) -> Column:
    """A negative is right only without a prediction; an empty label never is."""
    blank = F.coalesce(predicted, F.lit("")) == ""
    return F.when(label == "", False).when(label == NEGATIVE, blank).otherwise(~blank & (label == predicted))


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    right = F.count_if(is_correct(F.col(label), F.col(predicted)))
    return df.agg(F.count("*").alias("total"), right.alias("correct"), F.coalesce(F.round(F.try_divide(right, F.count("*")), 6), F.lit(0.0)).alias("accuracy"))


def separation(df: DataFrame, by: list[str], inside: Column, score: str) -> DataFrame:
    """Per anchor and screen: the worst score where it belongs against the best where it doesn't, their gap, and, if that is positive, the midpoint as a threshold; else 0."""
    n = F.count_if(inside)
    worst = F.least(F.lit(1.0), F.min(F.when(inside, F.col(score))))
    best = F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(~inside, F.col(score))), F.lit(0.0)))
    out = df.groupBy(*by).agg(n.alias("in_count"), F.count_if(~inside).alias("out_count"), F.coalesce(worst, F.lit(0.0)).alias("worst_in"), best.alias("best_out"))
    some = F.col("in_count") > 0
    return out.withColumn("gap", F.when(some, F.col("worst_in") - F.col("best_out")).otherwise(0.0)).withColumn("overlap", ~some | (F.col("worst_in") <= F.col("best_out"))).withColumn("suggested", F.when(~F.col("overlap"), (F.col("worst_in") + F.col("best_out")) / 2).otherwise(0.0))


def recognised(df: DataFrame, frame: str, screen: str, score: str, threshold: str) -> DataFrame:
    """Per frame the screen whose weakest anchor is strongest, all anchors passing their thresholds; ties go to the first name."""
    per = df.groupBy(frame, screen).agg(F.bool_and(F.col(score) >= F.col(threshold)).alias("ok"), F.min(score).alias("confidence")).where("ok")
    return per.groupBy(frame).agg(F.min_by(screen, F.struct(-F.col("confidence"), F.col(screen))).alias("screen"), F.max("confidence").alias("confidence"))


def best_read(df: DataFrame, by: list[str], text: str, confidence: str, order: str) -> DataFrame:
    """Per field the reading of highest confidence, the earlier of equals, then the smaller text; a blank never wins over a text."""
    rank = F.struct((F.trim(text) == "").cast("int"), -F.col(confidence), F.col(order), F.col(text))
    return df.groupBy(*by).agg(F.min_by(F.struct(text, confidence, order), rank).alias("r")).select(*by, "r.*")


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, label, n, lo, mean, hi) over half-open bins between the edges, open at both ends."""
    k = F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda acc, e: acc + (F.col(value) >= e).cast("int"))
    titles = [f"< {edges[0]}", *(f"{a} - {b}" for a, b in zip(edges, edges[1:], strict=False)), f">= {edges[-1]}"]
    label = F.element_at(F.array(*map(F.lit, titles)), F.col("bin") + 1)
    got = df.select(k.alias("bin"), F.col(value).alias("v")).groupBy("bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("hi"))
    return got.select("bin", label.alias("label"), "n", "lo", "mean", "hi")


def matrix(counts: DataFrame, labels: list[str], predictions: list[str]) -> DataFrame:
    """A confusion table as a square: a row per label, a column per prediction, 0 where there is nothing; NONE comes last."""
    rest = sorted(p for p in predictions if p != NONE) + [NONE] * (NONE in predictions)
    wide = counts.where(F.col("label").isin(labels)).groupBy("label").pivot("predicted", rest).agg(F.sum("n"))
    return wide.na.fill(0).orderBy("label")


def gate(expected: DataFrame, facts: DataFrame, key: list[str], tolerance: float = 0.01) -> DataFrame:
    """(key, want, got, verdict) of hand-checked values against live facts: missing, off or ok."""
    both = expected.join(facts.withColumnRenamed("value", "got"), key, "left")
    close = F.when(F.col("want") == 0, F.col("got") == 0).otherwise(F.abs(F.col("got") - F.col("want")) / F.col("want") <= tolerance)
    return both.withColumn("verdict", F.when(F.col("got").isNull(), "missing").when(close, "ok").otherwise("off"))


def nearest_truth(created: DataFrame, truths: DataFrame, name: str, true_name: str, least: int = REVIEW) -> DataFrame:
    """(name, truth_id, score, truth_group) of the true member (truth_id, true_name, truth_group) most like each distinct name, of all groups, the lowest truth_id of equals; names without one of `least` have no row."""
    block = F.lit(0).alias("all")  # names meet by their pieces, whatever their group
    scored = likely.likely(created.select(block, name), truths.select(block, "truth_id", true_name), ["all"], name, true_name, "truth_id", least=least)
    best = scored.join(truths.select("truth_id", "truth_group"), "truth_id").groupBy(name)
    return best.agg(F.max_by(F.struct("truth_id", "score", "truth_group"), F.struct("score", -F.col("truth_id"))).alias("b")).select(name, "b.*")


def coverage(created: DataFrame, best: DataFrame, accept: int = 92) -> DataFrame:
    """(created_id, verdict) of created members by their best true one (created_id, truth_id, score, truth_group): covered, wrong group, orphan, or split if another covers the same one better or earlier."""
    rows = created.join(best, "created_id", "left").withColumn("_hit", F.coalesce(F.col("score") >= accept, F.lit(False)))
    hits = rows.where("_hit")
    owners = hits.groupBy("truth_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("created_id").alias("owner"))).alias("_o")).select("truth_id", "_o.owner")
    told = F.when(F.col("created_id") != F.col("owner"), "split").when(F.col("group") != F.col("truth_group"), "wrong group").otherwise("covered")
    out = hits.join(owners, "truth_id").select("created_id", "truth_id", "score", told.alias("verdict"))
    # orphans, of whom most can have no truth at all, meet nobody
    return out.union(rows.where("not _hit").select("created_id", "truth_id", "score", F.lit("orphan").alias("verdict")))


def read_verdicts(reads: DataFrame, truths: DataFrame, least: float) -> DataFrame:
    """reads (text, confidence) with a verdict: empty, exact, exact but weak, junk-prefixed (exact without its first word) or unmatched."""
    known = truths.select(F.col("name").alias("_t"), F.lit(True).alias("_known")).distinct()
    rest = F.regexp_replace(F.trim("text"), r"^\S+\s+", "")
    rows = reads.join(known, F.trim("text") == F.col("_t"), "left").withColumnRenamed("_known", "_exact").drop("_t")
    rows = rows.withColumn("_rest", rest).join(known.withColumnRenamed("_t", "_u"), (F.col("_rest") == F.col("_u")) & (F.col("_rest") != F.trim("text")), "left").drop("_u", "_rest")
    verdict = F.when(F.trim("text") == "", "empty").when(F.col("_exact") & (F.col("confidence") >= least), "exact").when(F.col("_exact"), "exact, weak").when(F.col("_known"), "junk-prefixed").otherwise("unmatched")
    return rows.withColumn("verdict", verdict).drop("_exact", "_known")


def creatable(scored: DataFrame, by: list[str], least: float, accept: int = 92) -> DataFrame:
    """Per true member its best read (highest score, then confidence, then text) and whether that could create it: creatable, low confidence or missed."""
    best = scored.groupBy(*by).agg(F.max_by(F.struct("text", "score", "confidence"), F.struct("score", "confidence", "text")).alias("_b")).select(*by, "_b.*")
    return best.withColumn("verdict", F.when(F.col("score") < accept, "missed").when(F.col("confidence") < least, "low confidence").otherwise("creatable"))


def united_scores(reads: DataFrame, members: DataFrame, block: list[str], row: str, text: str, member: str, name: str) -> DataFrame:
    """(row, member, score) of every row and member of a block: the highest edit_ratio of any of the row's texts; an empty text scores 0.

    A row's texts travel together, so each pair is made once and needs no aggregate, unless a row or member is in several places.
    """
    rows = reads.groupBy(*block, row).agg(F.collect_set(text).alias("_texts"))
    ratio = lambda t: F.when(t == "", 0).otherwise(names.edit_ratio(t, F.col(name)))
    pairs = rows.join(members.select(*block, member, name), block).select(row, member, F.array_max(F.transform("_texts", ratio)).alias("score"))
    twice = lambda df, key: df.groupBy(key).count().where("count > 1").limit(1).count() > 0
    return pairs.groupBy(row, member).agg(F.max("score").alias("score")) if twice(rows, row) or twice(members, member) else pairs


def best_texts(scores: DataFrame, row: list[str], mode: str) -> DataFrame:
    """Per row the text of the mode whose best score is highest, the first of equals, of texts that aren't empty."""
    tops = scores.where("text <> ''").groupBy(*row, mode, "text").agg(F.max("score").alias("_top"))
    return tops.groupBy(*row).agg(F.max_by("text", F.struct("_top", -F.col(mode))).alias("text"), F.max("_top").alias("top"))


def agreement(first: DataFrame, second: DataFrame, key: str, accept: int = 92) -> DataFrame:
    """Bands by how two ways of reading compare: agree, disagree, only one sure, both weak."""
    a = first.select(key, F.col("member_id").alias("_a"), (F.col("score") >= accept).alias("_sa"))
    b = second.select(key, F.col("member_id").alias("_b"), (F.col("score") >= accept).alias("_sb"))
    both = a.join(b, key, "full_outer").select(key, "_a", "_b", F.coalesce("_sa", F.lit(False)).alias("_sa"), F.coalesce("_sb", F.lit(False)).alias("_sb"))
    verdict = F.when(F.col("_sa") & F.col("_sb"), F.when(F.col("_a") == F.col("_b"), "agree").otherwise("disagree")).when(F.col("_sa"), "first only").when(F.col("_sb"), "recovered").otherwise("both weak")
    return both.select(key, verdict.alias("verdict"))


def clear_winner(scores: DataFrame, by: str, name: str, score: str, gap: float) -> DataFrame:
    """(by, name) of the best score if it leads the next by the gap, else null; one score alone leads by its whole height."""
    order = Window.partitionBy(by).orderBy(F.desc(score), name)
    top = scores.withColumn("_n", F.row_number().over(order)).where("_n <= 2")
    height = lambda k: F.max(F.when(F.col("_n") == k, F.col(score)))
    return top.groupBy(by).agg(F.when(height(1) - F.coalesce(height(2), F.lit(0.0)) >= gap, F.max(F.when(F.col("_n") == 1, F.col(name)))).alias(name))
