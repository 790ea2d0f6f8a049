"""Entity resolution: ranking candidates, closed-set assignment, attribution, inferred zeros and reconciliation."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import names, parse
from sightline.functions.names import ACCEPT, REVIEW, token_set_ratios

CONFIDENT, RESIDUAL, DUPLICATE = 1, 2, 3
FLOOR, MARGIN = 60, 20
WRITE = 0.80
RESIDUAL_MATCH, ZERO = 0.85, 0.90
#: Confidence of a name from which a member may be created.
LEGIBLE = 0.4
#: A cell that no claim may take any more.
TAKEN = -1
PAIR = "row int, member int, score int, phase int"


def candidates(reads: DataFrame, members: DataFrame, block: list[str], read: str, name: str) -> DataFrame:
    """Scores of reads against the names and aliases of the members in the same block (a capture's own alliance): the best per member.

    Distinct pairs are scored once. The blocks bound the pairs; there is no join across blocks.
    """
    pairs = reads.select(*block, read).distinct().join(members.select(*block, name, "member_id").distinct(), block)
    scored = pairs.withColumn("score", names.likeness(read, name))
    best = scored.groupBy(*block, read, "member_id").agg(F.max("score").alias("score"))
    return reads.join(best, [*block, read])


def assign(scores: np.ndarray, floor: int = FLOOR, margin: int = MARGIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Member (-1: none), score and phase of each row of a matrix rows by members.

    A claim takes the best free cell of all rows that lead by enough: their best
    free member scores the floor at least and beats the next free one by the margin, which is void when one member is left. Claimed rows and
    members leave the matrix. Claims of the accepted score by one point come first; then rows as good as that against a claimed member are
    duplicates and leave; then claims go on from the floor by the margin. Ties go to the first row, then the first member.
    """
    cells = scores.astype(np.int64)
    member, score, phase = np.full(len(cells), -1), np.zeros(len(cells), np.int64), np.zeros(len(cells), np.int64)
    every = np.arange(len(cells))
    # best and next free cell of each row; a claim changes those of the rows that it was one of
    column, other, best, second = (np.full(len(cells), TAKEN) for _ in range(4))

    def look(rows: np.ndarray) -> None:
        if not cells.shape[1]:
            return
        part, at = cells[rows], np.arange(len(rows))
        column[rows] = part.argmax(axis=1)
        best[rows] = part[at, column[rows]]
        part[at, column[rows]] = TAKEN - 1
        other[rows] = part.argmax(axis=1)
        second[rows] = np.maximum(part[at, other[rows]], TAKEN)

    look(every)
    for stage, least, lead in ((CONFIDENT, ACCEPT, 1), (RESIDUAL, floor, margin)):
        while cells.size:
            fits = np.where((best >= least) & ((second == TAKEN) | (best - second >= lead)), best, TAKEN)
            row = fits.argmax()
            if fits[row] == TAKEN:
                break
            member[row], score[row], phase[row] = column[row], best[row], stage
            taken = column[row]
            cells[row], cells[:, taken] = TAKEN, TAKEN
            best[row] = TAKEN
            look(every[((column == taken) | (other == taken)) & (best > TAKEN)])
        if stage == CONFIDENT:
            claimed = np.unique(member[member >= 0])
            again = (member < 0) & (scores[:, claimed] >= ACCEPT).any(axis=1)
            phase[again], cells[again], best[again] = DUPLICATE, TAKEN, TAKEN
    return member, score, phase


def assignments(scores: DataFrame, by: str, floor: int = FLOOR, margin: int = MARGIN) -> DataFrame:
    """Closed-set assignment per capture over (by, row, member, score); a pair that isn't there scores 0. A group is one capture's matrix, bounded by its roster."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, members = np.unique(pdf["row"]), np.unique(pdf["member"])
        matrix = np.zeros((len(rows), len(members)), np.int64)
        np.maximum.at(matrix, (np.searchsorted(rows, pdf["row"]), np.searchsorted(members, pdf["member"])), pdf["score"].to_numpy())
        member, score, phase = assign(matrix, floor, margin)
        got = pd.DataFrame({"row": rows, "member": np.where(member < 0, -1, members[member]), "score": score, "phase": phase}).astype("int32")
        got.insert(0, by, pdf[by].iloc[0])
        return got

    return scores.groupBy(by).applyInPandas(run, f"{by} {scores.schema[by].dataType.simpleString()}, {PAIR}")


def attributed(df: DataFrame, name: str, phase: Column, top: Column, text: Column, read_conf: Column, score: Column, lo: Column, hi: Column, retry: Column, retry_conf: Column, from_retry: Column) -> DataFrame:
    """Adds struct(outcome, value, confidence, reason) of each row, the checks in their order: duplicate, unmatched, parse, repair within bounds, late retry, order, confidence.

    A trailing artifact is trimmed before anything is parsed or repaired. A
    late retry is tried only where the first read wasn't a retry itself; it must parse within the bounds and brings its own confidence. Bounds that
    are closed and narrow raise a weak read to the least confidence that is written, but not a repaired one. Each step is a column of its
    own, so that none is computed anew wherever it is used.
    """
    given = {"phase": phase, "top": top, "text": parse.without_artifact(text), "read": read_conf, "score": score, "lo": lo, "hi": hi, "retry": retry_conf, "again": from_retry}
    c = {k: F.col(f"_a_{k}") for k in (*given, "first", "second", "fixed", "late", "value", "weak", "sure", "confidence", "reason", "outcome")}

    def step(df: DataFrame, **new: Column) -> DataFrame:
        return df.withColumns({f"_a_{k}": v for k, v in new.items()})

    out = step(df, **given, second=parse.points(parse.without_artifact(retry)))
    out = step(out, first=parse.points("_a_text"))
    out = step(out, fixed=F.when(c["first"].isNull(), parse.repaired_points("_a_text", "_a_lo", "_a_hi")))
    tried = c["first"].isNull() & c["fixed"].isNull() & ~c["again"] & parse.within("_a_second", "_a_lo", "_a_hi")
    out = step(out, late=F.when(tried, c["second"]))
    out = step(out, value=F.coalesce("_a_first", "_a_fixed", "_a_late"))
    match = F.when(c["phase"] == RESIDUAL, RESIDUAL_MATCH).otherwise(c["score"] / 100)
    out = step(out, weak=F.least(match, F.when(c["late"].isNotNull(), c["retry"]).otherwise(c["read"])), sure=c["fixed"].isNull() & (c["hi"] < 2**63 - 1) & (c["lo"] > 0) & (c["hi"] - c["lo"] <= c["value"]))
    out = step(out, confidence=F.when((c["weak"] < WRITE) & c["sure"], WRITE).otherwise(c["weak"]))
    unmatched = F.when(c["top"] >= REVIEW, "ambiguous_name_match").otherwise("no_confident_match")
    why = F.when(c["phase"] == 0, unmatched).when(c["value"].isNull(), "unparseable_points").when(~parse.within("_a_value", "_a_lo", "_a_hi"), "points_out_of_order").when(c["confidence"] < WRITE, "low_confidence_points")
    out = step(out, reason=F.when(c["phase"] != DUPLICATE, why))
    out = step(out, outcome=F.when(c["phase"] == DUPLICATE, "duplicate").when(c["reason"].isNotNull(), "review").otherwise("fact"))
    told = (c["outcome"] == "fact") | (c["reason"] == "low_confidence_points")
    result = F.struct(c["outcome"].alias("outcome"), F.when(c["outcome"] == "fact", c["value"]).alias("value"), F.when(told, F.round(c["confidence"], 6)).alias("confidence"), c["reason"].alias("reason"))
    return out.withColumn(name, result).drop(*(f"_a_{k}" for k in c))


def field_outcomes(rows: DataFrame, by: list[str], match: str, fields: dict[str, tuple[str, str, str]]) -> DataFrame:
    """One row per field of a matched row: (by, metric, label, value, confidence, outcome). fields: metric to (label, value column, confidence column).

    A value that did not parse, or is weaker than what is written, is for
    review; the confidence is the weaker of match and read. A created member matches by 1.
    """
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(label).alias("label"), F.col(v).cast("double").alias("value"), F.least(F.col(match), F.col(c)).alias("confidence")) for m, (label, v, c) in fields.items()))
    out = rows.select(*by, F.explode(each).alias("f")).select(*by, "f.*")
    outcome = F.when(F.col("value").isNull(), F.concat(F.lit("unparseable_"), F.col("label"))).when(F.col("confidence") < WRITE, F.concat(F.lit("low_confidence_"), F.col("label"))).otherwise("fact")
    return out.withColumn("outcome", outcome).withColumn("confidence", F.when(F.col("value").isNotNull(), F.col("confidence")))


def inferred_zeros(members: DataFrame, assigned: DataFrame, captures: DataFrame) -> DataFrame:
    """Members without a row get 0 in captures that are complete, fully attributed and not empty."""
    sound = captures.where("status = 'complete' and unidentified = 0 and parsed > 0").select("capture_id")
    return members.join(sound, "capture_id", "left_semi").join(assigned.select("capture_id", "member_id"), ["capture_id", "member_id"], "left_anti").select("capture_id", "member_id", F.lit(0.0).alias("value"), F.lit(ZERO).alias("confidence"))


def reconcile(groups: DataFrame, totals: DataFrame) -> DataFrame:
    """Status per capture: partial when a group's total is unknown or not what was parsed, when all groups miss the stated count, or when there is no group at all."""
    per = groups.groupBy("capture_id").agg(F.coalesce(F.bool_and(F.col("expected").isNotNull() & (F.col("parsed") == F.col("expected"))), F.lit(False)).alias("groups_ok"), F.sum("parsed").alias("parsed"))
    ok = F.coalesce(F.col("groups_ok"), F.lit(False)) & (F.col("stated").isNull() | (F.col("parsed") == F.col("stated")))
    return totals.join(per, "capture_id", "left").select("capture_id", F.coalesce("parsed", F.lit(0)).alias("parsed"), F.when(ok, "complete").otherwise("partial").alias("status"))


def group_tallies(rows: DataFrame, by: list[str], order: str, member: str, total: str) -> DataFrame:
    """Per group: rows parsed, those with a member, distinct members, the first total that its header shows, and whether a member may be created."""
    expected = F.min_by(total, F.when(F.col(total).isNotNull(), F.col(order)))
    out = rows.groupBy(*by).agg(F.count("*").alias("parsed"), F.count(member).alias("matched_or_created"), F.count_distinct(member).alias("members"), expected.alias("expected"))
    return out.withColumn("can_create", F.col("expected").isNotNull() & (F.col("members") < F.col("expected")))


def result_counters(outcomes: DataFrame, by: str) -> DataFrame:
    """Per capture how many rows became facts, went to review or were duplicates."""
    n = lambda kind: F.count_if(F.col("outcome") == kind)
    return outcomes.groupBy(by).agg(n("fact").alias("matched"), n("review").alias("queued"), n("duplicate").alias("duplicates"))


def once_per_row(reviews: DataFrame, row: list[str], order: str) -> DataFrame:
    """The first review of each collected row; later photographs of it bring no new work."""
    return reviews.withColumn("_n", F.row_number().over(Window.partitionBy(*row).orderBy(order))).where("_n = 1").drop("_n")


def with_retry(text: Column, confidence: Column, retry: Column, retry_confidence: Column) -> Column:
    """struct(text, confidence, retried): the second reading where the first is empty."""
    blank = text == ""
    return F.struct(F.when(blank, retry).otherwise(text).alias("text"), F.when(blank, retry_confidence).otherwise(confidence).alias("confidence"), blank.alias("retried"))


def seeds(rows: DataFrame, write: float = WRITE) -> DataFrame:
    """Adds points and seeds: whether a row may bound its neighbours; it has a member, parses, was read surely and not by a retry."""
    points = parse.points(parse.without_artifact("text"))
    return rows.withColumn("points", points).withColumn("seeds", (F.col("member") >= 0) & F.col("points").isNotNull() & (F.col("confidence") >= write) & ~F.col("retried"))


def roster_rows(pdf_rows: list[tuple], known: dict[int, str], expected: int | None) -> list[tuple]:
    """(ordinal, outcome, member) of roster rows in order; a created member is a candidate for the rows after it.

    Blank names are unreadable; the accepted score is a match, the review score ambiguous; below, a weak read is queued, and else a member is created while the
    group's stated total leaves room.
    """
    pool, used, out, new = list(known.items()), set(), [], -1
    for ordinal, name, conf in pdf_rows:
        if not (name or "").strip():
            out.append((ordinal, "unreadable_name", None))
            continue
        # of equal scores the member known for longer
        score, at = max(((x, -k) for k, x in enumerate(token_set_ratios([(name, n) for _, n in pool]))), default=(0, 0))
        if score >= ACCEPT:
            member = pool[-at][0]
            used.add(member)
            out.append((ordinal, "matched", member))
        elif score >= REVIEW:
            out.append((ordinal, "ambiguous_name_match", None))
        elif conf < LEGIBLE:
            out.append((ordinal, "low_confidence_name", None))
        elif expected is None:
            out.append((ordinal, "no_confident_match_group_count_unknown", None))
        elif len(used) >= expected:
            out.append((ordinal, "no_confident_match_group_full", None))
        else:
            pool.append((new, name))
            used.add(new)
            out.append((ordinal, "created", new))
            new -= 1
    return out


def roster_decisions(rows: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """(by, ordinal, outcome, member_id) of the rows (by, ordinal, name, confidence, expected) of each group, in order, against its members (by, member_id, name).

    A group is one header's rows in one capture: a member created for a row is a
    candidate for those after it, so the rows of a group are taken in turn. Created members get negative numbers, -1 being the first of a group.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("ordinal", ignore_index=True)
        known = dict(zip(right.sort_values("member_id")["member_id"].tolist(), right.sort_values("member_id")["name"].tolist(), strict=True))
        total = left["expected"].dropna()
        expected = int(total.iloc[0]) if len(total) else None  # the first that is known
        got = roster_rows(list(zip(left["ordinal"].tolist(), left["name"].tolist(), left["confidence"].tolist(), strict=True)), known, expected)
        out = pd.DataFrame(got, columns=["ordinal", "outcome", "member_id"])
        for name, value in zip(reversed(by), reversed(key), strict=True):
            out.insert(0, name, value)
        out["member_id"] = out["member_id"].astype("Int64")
        return out

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    # columns of their own, as both sides may come from one table
    rows, members = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (rows, members))
    return rows.groupBy(*by).cogroup(members.groupBy(*by)).applyInPandas(run, f"{kinds}, ordinal long, outcome string, member_id long")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
