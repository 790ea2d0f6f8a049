"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import Scratch

#: Rounds after which a graph without a fixed point is an error; each round at least halves the depth of every tree.
MAX_ROUNDS = 64


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for each end of an edge of (u, v); component is the smallest id that can be reached.

    Large-star and small-star steps (Kiveris and others, 2014): each hangs a
    node's neighbours on the smallest of them. All steps are aggregations with partial sums and
    equi-joins, so a node with very many neighbours is split by the adaptive skew join; each result is written, so lineage
    stays short. Loops and repeated edges are allowed; no edge gives an empty table.
    """
    cur = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(cur)
    if not mark[0]:
        return cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(MAX_ROUNDS):
        before = cur
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        mid = scratch.keep(large, "large")
        least = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = mid.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        cur = scratch.keep(small, "small")
        scratch.drop(mid, before)
        now = _mark(cur)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("no fixed point of the star contractions")
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).union(cur.select("v", "v").distinct())
