"""Tables that are published as a whole: written aside, checked as they were written, then made current by one atomic step; earlier versions stay readable.

A version is a folder of tables. What is current is told by a log of small files, numbered from 0, each naming a version. An entry is written aside and
moved to its number, which fails if the number is taken: of two writers at once one publishes, and the other is told. A writer that dies at any moment leaves
what was current.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources import blobs
from sightline.streaming import landing


class Refused(ValueError):
    """What was to be published has faults, or another version was published meanwhile; nothing was changed."""


def _log(spark: SparkSession, root: str) -> list[str]:
    """Versions by number. Entries are a line each, so reading them all is a small job."""
    where, fs = landing._files(spark, f"{root}/log")
    if not fs.exists(where):
        return []
    rows = spark.read.text(f"{root}/log").select("value", F.input_file_name().alias("entry")).collect()  # one a publication
    return [r.value for r in sorted(rows, key=lambda r: r.entry)]


def current(spark: SparkSession, root: str) -> str | None:
    """The version that readers see; None before the first."""
    log = _log(spark, root)
    return log[-1] if log else None


def _point(spark: SparkSession, root: str, number: int, version: str) -> None:
    """Appends an entry to the log, or is Refused if its number is taken. A renaming that replaces nothing is one step on file systems that have directories."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    where, fs = landing._files(spark, f"{root}/log")
    fs.mkdirs(where)
    aside, entry = landing._files(spark, f"{root}/aside-{uuid.uuid4().hex}")[0], jvm.org.apache.hadoop.fs.Path(where, f"{number:012d}")
    out = fs.create(aside, False)
    out.write(bytearray(version, "ascii"))
    out.close()
    rename = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = rename.getEnumConstants()[0]  # NONE: never over what is there
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, entry, how)
    except Exception as e:
        fs.delete(aside, False)
        raise Refused(f"another version is published as number {number}") from e


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], checks: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] | None = None) -> str:
    """Writes tables aside, runs the checks over what was written (each gives rows of faults) and publishes them; returns the version. With a fault nothing is published and Refused names the check and a fault."""
    number, version = len(_log(spark, root)), uuid.uuid4().hex
    place = f"{root}/versions/{version}"
    for name, df in tables.items():
        df.write.parquet(f"{place}/{name}")
    written = {name: spark.read.schema(df.schema).parquet(f"{place}/{name}") for name, df in tables.items()}
    try:
        for what, check in (checks or {}).items():
            fault = check(written).limit(1).collect()  # one row
            if fault:
                raise Refused(f"{what}: {fault[0].asDict()}")
        _point(spark, root, number, version)
    except Exception:
        where, fs = landing._files(spark, place)
        fs.delete(where, True)
        raise
    return version


def read(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    """A table of a version, or of the current one."""
    version = version or current(spark, root)
    if version is None:
        raise LookupError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/versions/{version}/{name}")


def rollback(spark: SparkSession, root: str) -> str:
    """Makes the version before the current one current again, as a new entry of the log; returns it."""
    log = _log(spark, root)
    before = [v for v in log if v != log[-1]]
    if not before:
        raise LookupError("there is no earlier version")
    _point(spark, root, len(log), before[-1])
    return before[-1]


def with_anchors(previous: DataFrame, new: DataFrame) -> DataFrame:
    """The manifest with anchors added, or replaced where the screen has one of that id. Columns are those of the previous manifest."""
    kept = previous.join(new.select("screen", "anchor_id"), ["screen", "anchor_id"], "left_anti")
    return kept.select(previous.columns).unionByName(new.select(previous.columns))


def anchor_faults(anchors: DataFrame) -> DataFrame:
    """(screen, anchor_id, fault) of what no reader of a manifest could use.

    Faults: a screen or id that is no label, a region or threshold out of range, an id twice on a screen, a flat template (variance 0), one that is larger
    than its region on a frame of reference_height, and a reference height that the lowest of the manifest's isn't equal to.
    """
    rect = (F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") <= 1) & (F.col("y2") <= 1) & (F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2"))
    fits = F.col("template_height") <= F.round((F.col("y2") - F.col("y1")) * F.col("reference_height"))
    lowest = anchors.agg(F.min("reference_height").alias("_lowest"))  # one row
    twice = anchors.groupBy("screen", "anchor_id").agg(F.count("*").alias("_n")).where("_n > 1").select("screen", "anchor_id", F.lit("twice").alias("fault"))
    wrong = {"screen": blobs.is_label(F.col("screen")), "anchor_id": blobs.is_label(F.col("anchor_id")), "region": rect, "threshold": F.col("threshold").between(0, 1), "flat": F.col("variance") > 0, "template": fits, "reference_height": (F.col("reference_height") > 0) & (F.col("reference_height") == F.col("_lowest"))}
    each = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in wrong.items())))
    return anchors.crossJoin(F.broadcast(lowest)).select("screen", "anchor_id", F.explode(each).alias("fault")).unionByName(twice)


def write_anchors(spark: SparkSession, root: str, new: DataFrame) -> str:
    """Publishes the manifest with new anchors, if what is then there has no fault; else Refused, and the manifest is what it was."""
    merged = with_anchors(read(spark, root, "anchors"), new) if current(spark, root) else new
    return publish(spark, root, {"anchors": merged}, {"anchors": lambda t: anchor_faults(t["anchors"])})


def record_captures(captures: DataFrame, frames: DataFrame, root: str, batch: int, on: str = "capture_id") -> None:
    """Writes a batch of captures: all their frames first, then the headers, by which readers find frames. A batch that is written again replaces its own rows. Frames without a header of their batch aren't read."""
    frames.write.mode("overwrite").parquet(f"{root}/frames/{batch:012d}")
    captures.write.mode("overwrite").parquet(f"{root}/captures/{batch:012d}")


def recorded(spark: SparkSession, root: str, captures: str, frames: str, on: str = "capture_id") -> tuple[DataFrame, DataFrame]:
    """(captures, frames) of the schemas given, of the batches whose headers were written whole; each frame has its header."""
    done = landing.folders(spark, f"{root}/captures")
    if not done:
        return spark.createDataFrame([], captures), spark.createDataFrame([], frames)
    heads = spark.read.schema(captures).parquet(*[f"{root}/captures/{n}" for n in done])
    rows = spark.read.schema(frames).parquet(*[f"{root}/frames/{n}" for n in done])
    return heads, rows.join(heads.select(on), on, "left_semi")
