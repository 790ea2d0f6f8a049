"""Tab-separated output of a text recogniser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def words(lines: DataFrame, by: str, order: str, line: str = "line") -> DataFrame:
    """Per read: its words joined by blanks and their mean confidence from 0 to 1.

    A line counts with twelve fields or more, a confidence of 0 or more in the
    eleventh and a word in the twelfth; the header has no such confidence. A read without words is an empty text of confidence 0.
    """
    f = F.split(line, "\t")
    conf, word = F.get(f, F.lit(10)).try_cast("double"), F.get(f, F.lit(11))
    good = (F.size(f) >= 12) & (conf >= 0) & (F.trim(word) != "")
    pairs = F.array_sort(F.collect_list(F.when(good, F.struct(order, word.alias("w")))))
    return lines.groupBy(by).agg(F.array_join(F.transform(pairs, lambda p: p["w"]), " ").alias("text"), F.coalesce(F.round(F.avg(F.when(good, conf)) / 100, 6), F.lit(0.0)).alias("confidence"))
