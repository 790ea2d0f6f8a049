"""Content-addressed rows: digests, sharded keys, writes that skip what is there, reads that verify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(c) -> Column:
    return F.sha2(c, 256)


def key(sum_: Column) -> Column:
    """sha256/ab/cd/<sum>; sums under four characters are not sharded."""
    return F.when(F.length(sum_) < 4, F.concat(F.lit("sha256/"), sum_)).otherwise(F.concat_ws("/", F.lit("sha256"), F.substring(sum_, 1, 2), F.substring(sum_, 3, 2), sum_))


def missing(rows: DataFrame, stored: DataFrame, on: str = "key") -> DataFrame:
    """Rows to write: those whose key is not stored, once each."""
    return rows.join(stored.select(on), on, "left_anti").dropDuplicates([on])


def verified(rows: DataFrame, content: str, expected: str) -> DataFrame:
    return rows.withColumn("intact", digest(F.col(content)) == F.col(expected))


def is_label(c: Column) -> Column:
    return c.rlike(r"^_?[a-z0-9][a-z0-9_]*\z")


def is_hash(c: Column) -> Column:
    return c.rlike(r"^[0-9a-f]{64}\z")


def labelled_files(spark, root: str) -> DataFrame:
    """(label, hash, path) of the PNG files below folders named by label, and whether a file is stray (not named by a digest)."""
    # files are named by a pattern, as a folder whose name begins with "_" would be passed over in a listing
    df = spark.read.format("binaryFile").load(f"{root}/*/*.png").select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)\.png\z", 1)
    return df.select(F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1).alias("label"), name.alias("hash"), "path", "length", (~is_hash(name)).alias("stray"))
