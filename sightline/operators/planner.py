"""Run histories and the work that is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import parse, schedule


def run_state(runs: DataFrame) -> DataFrame:
    """Per account and task: last_run, last_success, and failures after the last success; paused and running runs neither count nor reset."""
    by = ["account_id", "task"]
    last = F.max(F.when(F.col("status") == "succeeded", F.col("started_at"))).over(Window.partitionBy(*by))
    marked = runs.where(F.col("status").isin("succeeded", "failed")).withColumn("_last", last)
    after = (F.col("status") == "failed") & (F.col("_last").isNull() | (F.col("started_at") > F.col("_last")))
    done = marked.groupBy(*by).agg(F.max("started_at").alias("last_run"), F.max("_last").alias("last_success"), F.count_if(after).alias("failures"))
    every = runs.select(*by).distinct()
    return every.join(done, by, "left").select(*by, "last_run", "last_success", F.coalesce("failures", F.lit(0)).alias("failures"))


def due_work(accounts: DataFrame, tasks: DataFrame, state: DataFrame, now: Column, paused: bool = False) -> DataFrame:
    """(account_id, task, overdue) of what is due at a moment, overdue in nanoseconds, the most overdue first, then by task and account.

    accounts: account_id, role, enabled. tasks: task, cadence_ns, roles, days
    (0 is Sunday), enabled. state: account_id, task, last_ns, failures. An account rests in its offline window. A pair that never ran is due at once; another
    after its cadence, shifted by the jitter, and after a back-off that doubles with failures. Accounts meet tasks by role: tasks are
    exploded over their distinct roles, so there is no cross join, and windows are found once an account. While everything is paused nothing is due.
    """
    today = F.dayofweek(now) - 1
    awake = accounts.where(F.col("enabled") & ~schedule.offline(F.col("account_id"), now)).select("account_id", "role")
    by_role = tasks.where(F.col("enabled") & F.array_contains("days", today)).select("task", "cadence_ns", F.explode(F.array_distinct("roles")).alias("role"))
    pairs = (awake.where(F.lit(not paused))).join(F.broadcast(by_role), "role").join(state, ["account_id", "task"], "left")  # tasks are a configuration of some dozen rows
    at = F.unix_micros(now) * 1000
    jitter = schedule.cadence_offset(F.col("account_id"), F.col("task"), F.col("last_ns"), F.col("cadence_ns"))
    due = F.when(F.col("last_ns").isNull(), at).otherwise(F.col("last_ns") + F.col("cadence_ns") + jitter + parse.backoff("cadence_ns", F.coalesce("failures", F.lit(0))))
    return pairs.withColumn("overdue", at - due).where("overdue >= 0").select("account_id", "task", "overdue")


def first_due(due: DataFrame, n: int = 1) -> DataFrame:
    """The n pairs to run next."""
    return due.orderBy(F.desc("overdue"), "task", "account_id").limit(n)
