"""Profiles of images as tables of pixels (frame, y, x, v): what plain aggregates can tell without a kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_profile(pixels: DataFrame) -> DataFrame:
    """Mean brightness of each row: (frame, y, mean)."""
    return pixels.groupBy("frame", "y").agg(F.avg("v").alias("mean"))


def moments(pixels: DataFrame) -> DataFrame:
    """Mean, and sum of squared distances from it, of each frame."""
    return pixels.groupBy("frame").agg(F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("variance"))


def equalising_table(pixels: DataFrame) -> DataFrame:
    """(frame, v, n, cdf, mapped): histogram, running sum and the value that equalisation gives each grey value of a frame."""
    hist = pixels.groupBy("frame", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("frame").orderBy("v")  # 256 values at the most
    every = Window.partitionBy("frame")
    out = hist.withColumn("cdf", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low, size = F.min("cdf").over(every), F.sum("n").over(every)
    spread = size - low
    return out.withColumn("mapped", F.when(spread > 0, F.floor((F.col("cdf") - low) * 255 / spread)).otherwise(F.col("v")).cast("long"))


def phases(profile: DataFrame, pitches: DataFrame) -> DataFrame:
    """(frame, pitch, phase, contrast, rows): for each pitch the phase whose rows are brightest (the first of equals). pitches: a small table (pitch)."""
    each = profile.crossJoin(F.broadcast(pitches)).groupBy("frame", "pitch", F.pmod("y", "pitch").alias("phase")).agg(F.avg("mean").alias("mean"), F.count("*").alias("rows"))
    best = F.max_by(F.struct("phase", "rows"), F.struct(F.round("mean", 9), -F.col("phase")))
    return each.groupBy("frame", "pitch").agg(best.alias("b"), F.round(F.max("mean") - F.min("mean"), 6).alias("contrast")).select("frame", "pitch", "b.phase", "contrast", "b.rows")


def fitting_pitch(found: DataFrame) -> DataFrame:
    """Of the pitches of a frame with two rows or more the one of the highest contrast times the root of its rows, the smallest of equals."""
    norm = F.round(F.col("contrast") * F.sqrt("rows"), 6)
    return found.where("rows > 1").groupBy("frame").agg(F.max_by(F.struct("pitch", "contrast"), F.struct(norm, -F.col("pitch"))).alias("b")).select("frame", "b.*")
