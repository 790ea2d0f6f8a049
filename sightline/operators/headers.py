"""Header cards of a list over its frames: found in the space that bands leave free, told by the badge that clearly wins there, and the owners of the bands below."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.sequences import free_windows


def cards(frames: DataFrame, bands: DataFrame, badges: DataFrame, by: list[str], top: float, bottom: float, least: float, gap: float, half: float, height: float) -> DataFrame:
    """(by, y0, rank, score, lead) of the header cards of frames (by), all in pixels.

    bands (by, lo, hi) are the rows that a frame shows, badges (by, y, rank, score) where a template was found and how well.
    A free window between top and bottom has a card if the best rank in it leads the next other one by the gap, and if the card, half a card
    either way of the badge, is within the frame's height. A rank alone leads by its whole score; equal scores of a rank are its upper badge,
    equal scores of two ranks lead by nothing. A frame without bands is one window.
    """
    empty = frames.select(*by, F.lit(top).alias("lo"), F.lit(top).alias("hi"))
    free = free_windows(bands.select(*by, "lo", "hi").unionByName(empty), by, "lo", "hi", top, bottom, least)
    inside = badges.join(free, by).where((F.col("y") >= F.col("start")) & (F.col("y") < F.col("stop")))
    ranks = inside.groupBy(*by, "start", "rank").agg(F.max(F.struct("score", (-F.col("y")).alias("up"))).alias("b"))
    best = F.max(F.struct("b", "rank")).alias("first")
    scores = F.collect_list("b.score").alias("scores")  # one a rank
    top_two = ranks.groupBy(*by, "start").agg(best, scores).withColumn("lead", F.col("first.b.score") - F.coalesce(F.get(F.sort_array("scores", asc=False), F.lit(1)), F.lit(0.0)))
    y = -F.col("first.b.up")
    return top_two.where((F.col("lead") >= gap) & (y - half >= 0) & (y + half <= height)).select(*by, (y - half).alias("y0"), F.col("first.rank").alias("rank"), F.col("first.b.score").alias("score"), "lead")


def owned(bands: DataFrame, found: DataFrame, sticky: DataFrame, by: list[str], at: str = "lo") -> DataFrame:
    """Bands with owner: the rank of the last card at or above their top, else the sticky header's (by, rank). A frame whose sticky header can't be read has no owners: it is for review as a whole."""
    readable = sticky.where(F.col("rank").isNotNull()).select(*by, F.col("rank").alias("_sticky"))
    rows = bands.join(readable, by, "left").select(*by, F.col(at).alias("_y"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_rank"), "_sticky", F.struct(*bands.columns).alias("_band"))
    heads = found.select(*by, F.col("y0").alias("_y"), F.lit(0).alias("_kind"), F.col("rank").alias("_rank"))
    last = F.last("_rank", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_y", "_kind", "_rank").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.unionByName(heads, allowMissingColumns=True).withColumn("_owner", last).where("_kind = 1")
    return placed.select("_band.*", F.when(F.col("_sticky").isNotNull(), F.coalesce("_owner", "_sticky")).alias("owner"))


def tallies(owners: DataFrame, found: DataFrame, sticky: DataFrame, by: list[str], capture: str) -> DataFrame:
    """(capture, rank, frames, bands) of every header of a capture, stuck or a card, also of those that no band belongs to, whose bands are 0; frames that show it."""
    seen = found.select(*by, "rank").unionByName(sticky.where(F.col("rank").isNotNull()).select(*by, "rank")).distinct()
    shown = seen.groupBy(capture, "rank").agg(F.count("*").alias("frames"))
    rows = owners.where(F.col("owner").isNotNull()).groupBy(capture, F.col("owner").alias("rank")).agg(F.count("*").alias("bands"))
    return shown.join(rows, [capture, "rank"], "left").select(capture, "rank", "frames", F.coalesce("bands", F.lit(0)).alias("bands"))
