"""The driver's tables, and the stand-ins for observations made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import parse


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts_of(lines: DataFrame) -> DataFrame:
    """Facts: a supplier is a member, a return flag a metric, a line its value, a discount the confidence."""
    return lines.select(F.col("l_suppkey").alias("member_id"), F.col("l_returnflag").alias("metric"), parse.period_key("l_shipdate").alias("period_key"), F.col("l_linestatus").alias("source"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("observed_at"), F.col("l_extendedprice").alias("value"), F.col("l_discount").cast("float").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of(table(spark, sf_dir, "lineitem"))


FACTS_SQL = """facts AS (SELECT l_suppkey AS member_id, l_returnflag AS metric, strftime(l_shipdate, '%G-W%V') AS period_key, l_linestatus AS source, strftime(l_shipdate, '%Y-%m-%d') AS observed_at, l_extendedprice AS value, CAST(l_discount AS FLOAT) AS confidence, l_orderkey * 10 + l_linenumber AS arrival FROM lineitem)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task runs: an event of a user; purchases succeed, errors fail, the rest is paused or running."""
    ev = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "paused").otherwise("running")
    return ev.select("event_id", F.col("user_id").alias("account_id"), F.concat(F.lit("task"), (F.col("event_id") % 3).cast("string")).alias("task"), status.alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("started_at"), "value")


RUNS_SQL = """runs AS (SELECT event_id, user_id AS account_id, 'task' || CAST(event_id % 3 AS VARCHAR) AS task, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'paused' ELSE 'running' END AS status, epoch_us(ts) AS started_at, value FROM events)"""
