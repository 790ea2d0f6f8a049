"""The committed index of a corpus as YAML text: one entry of scalars a frame, sorted by hash; read and written by Spark, entry by entry.

    frames:
        - hash: ...
          label: ...

A folder's parts in order are the file. Blank entries are 0, "" and the year 1, as in the committed files, and null in the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "hash string, label string, width int, height int, captured_at timestamp, device string, game_version string"
FIELDS = {"label": "string", "width": "int", "height": "int", "captured_at": "timestamp", "device": "string", "game_version": "string"}
HEAD, NEVER = "- hash: ", "0001-01-01T00:00:00Z"


def _quoted(c: str) -> Column:
    """A string in double quotes: escapes are those of JSON, which YAML's include."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}\z', 1)


def _plain(c: Column) -> Column:
    """The string that a scalar stands for, in double quotes, in single ones, or plain."""
    double = F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string")["v"]
    single = F.regexp_replace(F.regexp_extract(c, r"^'(.*)'\z", 1), "''", "'")
    return F.when(c.startswith('"'), double).when(c.startswith("'"), single).otherwise(c)


def write_index(index: DataFrame, path: str, indent: int = 4) -> None:
    """Writes the entries (columns of SCHEMA) sorted by hash; strings are quoted, so that none is read as a number or a date."""
    lines = {"hash": F.col("hash"), "label": F.col("label"), "width": F.coalesce("width", F.lit(0)).cast("string"), "height": F.coalesce("height", F.lit(0)).cast("string"), "captured_at": F.coalesce(F.date_format(F.to_utc_timestamp("captured_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(NEVER)), "device": _quoted("device"), "game_version": _quoted("game_version")}
    pad = " " * indent
    entry = F.concat_ws("\n", *(F.concat(F.lit(f"{pad}{'- ' if k == 'hash' else '  '}{k}: "), v) for k, v in lines.items()))
    head = index.sparkSession.createDataFrame([("", "frames:")], "k string, value string")
    index.select(F.col("hash").alias("k"), entry.alias("value")).unionByName(head).orderBy("k").select("value").write.mode("overwrite").text(path)


def read_index(spark: SparkSession, path: str, indent: int = 4) -> DataFrame:
    """The entries of an index, a file or a folder of parts, indented so. The text is split at entries, so a large file is read by many tasks."""
    pad = " " * indent
    text = F.regexp_replace(F.col("value"), rf"^\s*{HEAD}", "")
    rows = spark.read.option("lineSep", f"\n{pad}{HEAD}").text(path).select(text.alias("value")).where(~F.col("value").rlike(r"^(frames:|\s*\z)"))
    field = lambda name: F.nullif(_plain(F.regexp_extract("value", rf"(?m)^{pad}  {name}: *(.*?) *$", 1)), F.lit(""))
    value = {"string": lambda c: c, "int": lambda c: F.nullif(c.cast("int"), F.lit(0)), "timestamp": lambda c: F.when(c != NEVER, c.cast("timestamp"))}
    return rows.select(F.regexp_extract("value", r"^(\S+)", 1).alias("hash"), *(value[kind](field(name)).alias(name) for name, kind in FIELDS.items()))
