"""Labelled frames as tables (hash, label, ...): adding, relabelling, indexing, pushing and pulling. Each function returns the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.sources import blobs

UNSORTED = "_unsorted"


def add_frames(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The corpus with new frames; bytes that are there under any label, or came earlier, are not added again. added tells which are new."""
    rows = existing.select("hash", "label", F.lit(False).alias("added"), F.lit(-1).cast("long").alias("_o")).unionByName(new.select("hash", "label", F.lit(True).alias("added"), F.col(order).cast("long").alias("_o")))
    first = F.min_by(F.struct("label", "added"), F.struct("_o", "label"))
    return rows.groupBy("hash").agg(first.alias("f")).select("hash", "f.*")


def relabel(frames: DataFrame, moves: DataFrame) -> DataFrame:
    """Frames under their new labels; moves: (hash, label). Labels that are none are refused."""
    bad = moves.where(~blobs.is_label(F.col("label"))).limit(1).collect()  # one row
    if bad:
        raise ValueError(f"not a label: {bad[0].label}")
    return frames.join(moves.select("hash", F.col("label").alias("_to")), "hash", "left").withColumn("label", F.coalesce("_to", "label")).drop("_to")


def reindex(previous: DataFrame, frames: DataFrame, metas: DataFrame, columns: list[str]) -> DataFrame:
    """The index of the frames there are: what a new meta says wins entirely, else the previous entry stays, else blanks."""
    old = previous.select("hash", F.struct(*columns).alias("_old"))
    new = metas.select("hash", F.struct(*columns).alias("_new"))
    return frames.select("hash", "label").join(old, "hash", "left").join(new, "hash", "left").withColumn("_m", F.coalesce("_new", "_old")).select("hash", "label", *(F.col(f"_m.{c}").alias(c) for c in columns))


def to_fetch(index: DataFrame, stored: DataFrame) -> DataFrame:
    """Entries whose bytes are not stored here, once each."""
    return blobs.missing(index, stored, "hash")


def record(burst: DataFrame, existing: DataFrame, by: str) -> DataFrame:
    """Per burst: frames captured for the first time, and those whose bytes were there, before or earlier in any burst."""
    nth = F.row_number().over(Window.partitionBy("hash").orderBy("seq"))
    known = existing.select("hash", F.lit(True).alias("_known")).dropDuplicates(["hash"])
    rows = burst.withColumn("_n", nth).join(known, "hash", "left")
    again = F.coalesce("_known", F.lit(False)) | (F.col("_n") > 1)
    return rows.groupBy(by).agg(F.count_if(~again).alias("captured"), F.count_if(again).alias("recaptured"))


def labelled(frames: DataFrame) -> DataFrame:
    """Frames that have been sorted, of well-formed labels and hashes."""
    return frames.where((F.col("label") != UNSORTED) & blobs.is_label(F.col("label")) & blobs.is_hash(F.col("hash")))


def manifest_faults(anchors: DataFrame) -> DataFrame:
    """(anchor_id, fault) of a manifest (anchor_id, template, reference_height, x1, y1, x2, y2, threshold): sizes, rectangles and thresholds out of range, and overlaps.

    Rectangles of one template must not overlap. They are met in a grid of their
    template, each in the cells that it touches, so distant ones are never paired.
    """
    rect = (F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") <= 1) & (F.col("y2") <= 1) & (F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2"))
    each = F.array_compact(F.array(F.when(~(F.col("reference_height") > 0), "reference_height"), F.when(~rect, "rect"), F.when(~F.col("threshold").between(0, 1), "threshold")))
    plain = anchors.select("anchor_id", F.explode(each).alias("fault"))
    pairs = overlaps(anchors.where(rect), "anchor_id", ["template"])
    return plain.union(pairs.select(F.explode(F.array("a", "b")).alias("anchor_id"), F.lit("overlap").alias("fault")).distinct())


def overlaps(rects: DataFrame, key: str, by: list[str], cells: int = 16) -> DataFrame:
    """(a, b), a < b, of rectangles (x1, y1, x2, y2 in fractions) of the same `by` that overlap; edges that only touch don't."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) * cells), F.floor(F.col(hi) * cells))
    dealt = rects.select(F.col(key).alias("_k"), *by, "x1", "y1", "x2", "y2", F.explode(span("x1", "x2")).alias("_cx")).withColumn("_cy", F.explode(span("y1", "y2")))
    left, right = dealt.alias("l"), dealt.alias("r")
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*by, "_cx", "_cy")]
    meet = (F.col("l._k") < F.col("r._k")) & (F.col("l.x1") < F.col("r.x2")) & (F.col("r.x1") < F.col("l.x2")) & (F.col("l.y1") < F.col("r.y2")) & (F.col("r.y1") < F.col("l.y2"))
    # a pair is told once, in the first cell that both touch
    first = (F.col("l._cx") == F.floor(F.greatest("l.x1", "r.x1") * cells)) & (F.col("l._cy") == F.floor(F.greatest("l.y1", "r.y1") * cells))
    # each rectangle is many rows here, which the planner's estimate doesn't know: it would broadcast all of them
    return left.join(right.hint("merge"), [*on, meet, first]).select(F.col("l._k").alias("a"), F.col("r._k").alias("b"))


def shape_faults(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n) of the rows of hand-checked fixtures that break a rule; no row means that all hold."""
    counts = rows.agg(*(F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules))).alias("f")).select("f.*").where("n > 0")


def write_blobs(rows: DataFrame, stored: DataFrame | None, root: str) -> None:
    """Appends the rows (key, content) that aren't stored, in folders by the first two digits; what a failed job leaves behind is never committed."""
    new = rows.dropDuplicates(["key"]) if stored is None else blobs.missing(rows, stored)
    new.withColumn("shard", F.substring("key", 1, 2)).write.mode("append").partitionBy("shard").parquet(root)


def read_blobs(spark: SparkSession, root: str, keys: DataFrame | None = None) -> DataFrame:
    """Stored blobs, those of keys or all, each hashed anew; intact is false where the bytes are not the key's."""
    df = spark.read.parquet(root)
    if keys is not None:
        df = df.join(keys.withColumn("shard", F.substring("key", 1, 2)).select("key", "shard"), ["shard", "key"], "left_semi")
    return blobs.verified(df, "content", "key").drop("shard")


def root_of(backend: str, place: str) -> str:
    """Address of a store: a folder for `fs`, a bucket for `s3`. A folder may not leave its place by '..'."""
    if backend == "fs":
        if ".." in place.split("/"):
            raise ValueError("the folder leaves its place")
        return place
    if backend == "s3":
        return f"s3a://{place}"
    raise ValueError(f"unknown store {backend}")


def root_column(backend: Column, place: Column) -> Column:
    """root_of for columns; a row whose folder leaves its place, or whose store isn't known, is an error, a missing place has no address."""
    inside = F.when(F.array_contains(F.split(place, "/"), ".."), F.raise_error(F.lit("the folder leaves its place"))).otherwise(place)
    return F.when(place.isNull(), F.lit(None)).when(backend == "fs", inside).when(backend == "s3", F.concat(F.lit("s3a://"), place)).otherwise(F.raise_error(F.concat(F.lit("unknown store "), backend)))
