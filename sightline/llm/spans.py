"""Where patterns match, as DataFrame columns: spans in code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,kind:int,stop:int,body:string,left:string>>"
#: Lengths that are added up one by one; more are added up in blocks of so many.
BLOCK = 128


def _sums(lengths: Column) -> Column:
    """array<int>: 0 and the running sums, by appending."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def with_matches(df: DataFrame, text: str, pattern: str, kind: int, name: str, group: int = 0, lead: int = 0) -> DataFrame:
    """Adds column name: leftmost non-overlapping matches of a pattern that never matches nothing, in text order.

    body holds what the group matched, left the last `lead` words, at least, before the
    match, white space between them as single spaces; of earlier matches only the one before counts. Splitting gives the text between the matches, extracting the matches; running sums of both lengths are
    the places, taken in blocks, so a text with very many matches costs little more than in proportion. A text without a match costs one search.
    The steps are columns of their own, as each is used more than once.
    """
    found, gaps, bodies, steps, blocks = (f"_{x}" for x in ("found", "gaps", "bodies", "steps", "blocks"))
    some = F.col(text).rlike(pattern)
    none = F.array().cast("array<string>")
    df = df.withColumn(found, F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(bodies, F.when(F.size(found) > 0, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none) if group else F.col(found))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn(steps, F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m)))
    starts = F.sequence(F.lit(0), F.size(steps), F.lit(BLOCK))
    df = df.withColumn(blocks, F.when(F.size(steps) > 0, F.transform(starts, lambda b: F.slice(F.col(steps), b + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<array<int>>")))
    before = f"{blocks}_before"
    df = df.withColumn(before, _sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))))
    stops = F.flatten(F.zip_with(F.slice(before, 1, F.size(blocks)), blocks, lambda at, b: F.transform(F.slice(_sums(b), 2, F.lit(BLOCK)), lambda x: x + at)))
    df = df.withColumn("_stops", stops)
    if lead:
        tail = lambda x: F.substring_index(F.regexp_replace(x, r"\s+", " "), " ", -lead - 1)
        df = df.withColumn("_tails", F.transform(F.slice(gaps, 1, F.size(found)), tail))
        left = F.zip_with("_tails", F.concat(F.array(F.lit("")), F.zip_with("_tails", found, lambda g, m: F.concat(g, m))), lambda g, p: F.concat(p, g))
        df = df.withColumn("_lead", F.slice(left, 1, F.size(found))).drop("_tails")
    else:
        df = df.withColumn("_lead", F.transform(found, lambda m: F.lit("")))
    zipped = F.arrays_zip(F.col(bodies).alias("b"), F.transform(found, lambda m: F.length(m)).alias("n"), F.col("_stops").alias("e"), F.col("_lead").alias("l"))
    spans = F.transform(zipped, lambda x: F.struct((x["e"] - x["n"]).alias("start"), F.lit(kind).alias("kind"), x["e"].alias("stop"), x["b"].alias("body"), x["l"].alias("left")))
    return df.withColumn(name, spans.cast(SPAN)).drop(found, gaps, bodies, steps, blocks, before, "_stops", "_lead")


def joined(spans: str, kinds: list[str]) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in kinds))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))


def count_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def apart(spans: str, others: str) -> Column:
    """The spans that overlap none of the others."""
    return F.when(F.size(others) == 0, F.col(spans)).otherwise(F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["stop"]) & (s["start"] < o["stop"]))))
