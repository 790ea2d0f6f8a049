"""Outcomes of task runs from a stream of their events: state by bucket of accounts and tasks, with timers in event time."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ENDS = ("succeeded", "failed")
OUTCOME = "account_id long, task string, run_id long, started_ms long, outcome string, ended_ms long"
#: Keys of the state that accounts and tasks are dealt to.
BUCKETS = 256
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunOutcomes(StatefulProcessor):
    """Events wait in state until the watermark has passed them, so they are taken in the order of their time however they arrive.

    A run is open from its `running` event on. The next event of its account and task ends it: with that event's status, or as stale if that is another
    start, or if it comes later than `wait_ms`. A run that nothing ends is stale once the watermark is `wait_ms` past its start; its state goes then.

    A key of the state is a bucket of accounts and tasks with one timer, as each call of the store is a message: so there are a few for each bucket and batch, not for each event.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "account_id long, task string, ms long, event_id long, status string")
        self.open = handle.getListState("open", "account_id long, task string, ms long, event_id long")
        #: When the next event is passed, or the next open run goes stale.
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        new = [row for pdf in rows for row in zip(*(pdf[c].tolist() for c in ("account_id", "task", "ms", "event_id", "status")), strict=True)]
        if new:
            self.waiting.appendList(new)
            due = min(row[2] for row in new)
            before = self.timer.get()[0] if self.timer.exists() else None
            if before is None or due < before:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(due)
                self.timer.update((due,))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        ready, later = sorted(x for x in waiting if x[2] <= now), [x for x in waiting if x[2] > now]
        runs = {(account, task): (ms, event_id) for account, task, ms, event_id in self.open.get()} if self.open.exists() else {}
        before, out = dict(runs), []

        def close(who, outcome, ended=None):
            ms, event_id = runs.pop(who)
            out.append((*who, event_id, ms, outcome, ended))

        for account, task, ms, event_id, status in ready:
            who = (account, task)
            if who in runs:
                timely = status in ENDS and ms <= runs[who][0] + self.wait_ms
                close(who, status if timely else "stale", ms if timely else None)
            if status not in ENDS:
                runs[who] = (ms, event_id)
        for who in [w for w, (ms, _) in runs.items() if ms + self.wait_ms <= now]:
            close(who, "stale")
        for state, rows, changed in ((self.waiting, later, bool(ready)), (self.open, [(*who, *run) for who, run in runs.items()], runs != before)):
            if changed and rows:
                state.put(rows)
            elif changed:
                state.clear()
        due = min([x[2] for x in later] + [ms + self.wait_ms for ms, _ in runs.values()], default=None)
        # the timer that called is gone with the call
        if due is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(due)
            self.timer.update((due,))
        yield pd.DataFrame(out, columns=["account_id", "task", "run_id", "started_ms", "outcome", "ended_ms"]).astype({"ended_ms": "Int64"}) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def run_outcomes(events: DataFrame, wait_ms: int, late: str, buckets: int = BUCKETS) -> DataFrame:
    """A stream (account_id, task, run_id, started_ms, outcome, ended_ms) of runs as they are decided, from a stream (event_id, account_id, task, status, ts).

    status is running, succeeded or failed; other events neither open nor end a run. Events later than `late` behind the newest are dropped by the watermark; outcomes come when it
    has passed, so they don't depend on the order of arrival or on how events are dealt to batches. A bucket's waiting events and open runs are in memory at once; a stream keeps its number of buckets. Needs the state store that supports timers (with_timers).
    """
    timed = events.where(F.col("status").isin("running", *ENDS)).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    keyed = timed.select(F.col("account_id").cast("long").alias("account_id"), "task", F.unix_millis("at").alias("ms"), F.col("event_id").cast("long").alias("event_id"), "status", "at", F.pmod(F.xxhash64(F.col("account_id").cast("long"), "task"), F.lit(buckets)).cast("int").alias("bucket")).groupBy("bucket")
    return keyed.transformWithStateInPandas(RunOutcomes(wait_ms), OUTCOME, "Append", "EventTime")


class with_timers:  # noqa: N801
    """Context in which new streams use the state store that supports timers; the session's own choice comes back after."""

    def __init__(self, spark):
        self.spark, self.key = spark, "spark.sql.streaming.stateStore.providerClass"

    def __enter__(self):
        self.before = self.spark.conf.get(self.key)
        self.spark.conf.set(self.key, PROVIDER)

    def __exit__(self, *_):
        self.spark.conf.set(self.key, self.before)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
