"""The store's tables as explicit schemas, and where they are made."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

#: DDL of each table. Amounts are exact decimals, confidences 32-bit floats, times are UTC.
TABLES = {
    "devices": "device_id bigint, serial string, width int, height int, status string",
    "app_instances": "instance_id bigint, device_id bigint, package string, clone int",
    "accounts": "account_id bigint, instance_id bigint, uid string, server string, role string, enabled boolean",
    "screenshots": "screenshot_id bigint, account_id bigint, sha256 string, blob_key string, taken_at timestamp",
    "flags": "only boolean, pause_all boolean, reason string",
    "task_runs": "run_id bigint, account_id bigint, task string, status string, error string, started_at timestamp, ended_at timestamp, screenshot_ids array<bigint>",
    "tasks": "task string, cadence_ns bigint, enabled boolean, roles array<string>, days array<smallint>",
    "alliances": "alliance_id bigint, tag string, name string, server string, member_count int, observed_at timestamp",
    "members": "member_id bigint, alliance_id bigint, name string, name_normalized string, rank string, active boolean, left_at timestamp",
    "member_aliases": "member_id bigint, alias string, alias_normalized string, created_at timestamp",
    "captures": "capture_id bigint, account_id bigint, route string, status string, rows_parsed int, started_at timestamp, finished_at timestamp",
    "capture_frames": "capture_id bigint, seq int, screenshot_id bigint, offset_px int, grp string",
    "participation_facts": "fact_id bigint, member_id bigint, metric string, period_key string, source string, observed_at timestamp, value decimal(38,6), confidence float, screenshot_id bigint, superseded_by bigint",
    "review_queue": "review_id bigint, capture_id bigint, screenshot_id bigint, row_y0 int, row_y1 int, raw_text string, candidates_json string, reason string, confidence float, status string, resolved_member bigint",
}
#: Facts are read by metric and period, so they lie in folders by these.
PARTITIONS = {"participation_facts": ["metric", "period_key"], "task_runs": ["task"]}

# The statuses and reasons that occur.
STATUSES = {"captures": ["running", "complete", "partial", "failed"], "task_runs": ["running", "succeeded", "failed", "paused"], "review_queue": ["pending", "resolved", "rejected"]}
REASONS = [
    "no_confident_match", "ambiguous_name_match", "unparseable_points", "points_out_of_order", "low_confidence_points",
    "unparseable_group_header", "unmatched_rank_badge", "unreadable_name", "low_confidence_name",
    "no_confident_match_group_full", "no_confident_match_group_count_unknown",
    "unparseable_power", "unparseable_level", "unparseable_last_active", "low_confidence_power", "low_confidence_level", "low_confidence_last_active",
]


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def migrate(spark: SparkSession, database: str) -> list[str]:
    """Makes the tables that a database lacks, as Parquet; returns their names. A second call makes none."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    new = [n for n in TABLES if not spark.catalog.tableExists(f"{database}.{n}")]
    for name in new:
        by = f" PARTITIONED BY ({', '.join(PARTITIONS[name])})" if name in PARTITIONS else ""
        spark.sql(f"CREATE TABLE {database}.{name} ({TABLES[name]}) USING parquet{by}")
    return new
