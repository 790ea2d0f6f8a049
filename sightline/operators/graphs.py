"""Directed screen graphs: edge lists (a, b, n), n being an edge's place in its list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.streaming.runner import scratch


class NoPath(LookupError):
    """A node that cannot be reached."""


def shortest_paths(edges: DataFrame, start: int) -> DataFrame:
    """(node, hops, path) of every node that can be reached; of equally short paths the one over the earlier edges, compared from the start.

    One join of the newest nodes with the edges a step; what was reached before
    is left out, so a step costs its own frontier. Steps go on until nothing new is reached; each is written to the shared folder, so the plan of a step doesn't grow with those before it.
    """
    spark = edges.sparkSession
    schema, root = "node long, hops int, path array<long>, via array<long>", scratch(edges.sparkSession, "paths")
    spark.createDataFrame([(start, 0, [start], [])], schema).coalesce(1).write.parquet(f"{root}/0")
    hops = 0
    while True:
        front, reached = (spark.read.schema(schema).parquet(f"{root}/{which}") for which in (hops, "*"))
        if not front.limit(1).count():
            return reached.select("node", "hops", "path")
        hops += 1
        step = front.join(edges, front["node"] == edges["a"]).select(F.col("b").cast("long").alias("node"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array(F.col("b").cast("long"))).alias("path"), F.concat("via", F.array(F.col("n").cast("long"))).alias("via"))
        new = step.join(reached.select("node"), "node", "left_anti").groupBy("node").agg(F.min_by(F.struct("hops", "path", "via"), F.col("via")).alias("r")).select("node", "r.*")
        new.write.parquet(f"{root}/{hops}")


def path_to(paths: DataFrame, node: int) -> list[int]:
    """The nodes on the way to one, or NoPath."""
    found = paths.where(F.col("node") == node).select("path").limit(1).collect()  # one row
    if not found:
        raise NoPath(str(node))
    return found[0].path


def bad_edges(edges: DataFrame, nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Edges (a, b, n, anchor) with a fault: a screen at either end that isn't there, or no such tap anchor; one row a fault."""
    left = lambda c: edges.join(nodes.withColumnRenamed("node", c), c, "left_anti")
    out = left("a").select("n", F.lit("from").alias("fault")).union(left("b").select("n", F.lit("to").alias("fault")))
    return out.union(edges.join(anchors, "anchor", "left_anti").select("n", F.lit("anchor").alias("fault")))
