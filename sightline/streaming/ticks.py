"""The scheduler as a stream of ticks: each plans against the runs that earlier ticks left, and leaves the run that it made."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import planner
from sightline.streaming.landing import committed, folders

RUN = "account_id long, task string, status string, started_at long, error string"
log = logging.getLogger(__name__)


def runs_before(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The runs that ticks before a batch have left: a version of the history that stays the same if the batch is run again."""
    done = [name for name in folders(spark, path) if int(name) < number]
    return spark.read.schema(RUN).parquet(*[f"{path}/{name}" for name in done]) if done else spark.createDataFrame([], RUN)


def ticking(path: str, accounts: DataFrame, tasks: DataFrame, history: Callable[[], DataFrame], execute: Callable[[int, str], None] = lambda account, task: None, paused: Callable[[], bool] = lambda: False) -> Callable[[DataFrame, int], None]:
    """foreachBatch function over ticks (tick timestamp, one a batch; of more the last counts).

    Reads a snapshot (accounts, tasks, the pause flag, and runs of `history` (account_id, task, status, started_at in microseconds) with those under path), plans, and runs the one
    pair that is most overdue. The run is kept under path by the batch's number, succeeded or failed with the error. A snapshot that can't be read, or a task that fails, is logged and the
    next tick goes on. A tick with nothing due or everything paused leaves no run.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = batch.agg(F.max("tick")).first()[0]  # one row
        if now is None:
            return
        rows = []
        try:
            moment = F.lit(now).cast("timestamp")
            known = history().select("account_id", "task", "status", "started_at").union(runs_before(spark, path, number).select("account_id", "task", "status", "started_at"))
            state = planner.run_state(known).select("account_id", "task", (F.col("last_run") * 1000).alias("last_ns"), "failures")
            picked = planner.first_due(planner.due_work(accounts, tasks, state, moment, paused()).withColumn("at", F.unix_micros(moment))).first()  # one row
        except Exception:  # a scheduler that is meant to run for days outlives a bad read
            log.exception("tick %s could not be planned", now)
            picked = None
        if picked is not None:
            status, error = "succeeded", None
            try:
                execute(picked.account_id, picked.task)
            except Exception as e:  # noqa: BLE001  a failed task is a failed run
                log.warning("%s of account %s failed: %s", picked.task, picked.account_id, e)
                status, error = "failed", str(e)[:500]
            rows = [(picked.account_id, picked.task, status, picked.at, error)]
        spark.createDataFrame(rows, RUN).coalesce(1).write.mode("overwrite").parquet(f"{path}/{number:012d}")

    return run


def ticked(spark: SparkSession, path: str) -> DataFrame:
    """The runs that all ticks have left."""
    return committed(spark, path, RUN)
