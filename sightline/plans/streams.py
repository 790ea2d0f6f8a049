"""Streams over the driver's tables, run to the end of what is there, so that SQL can say what they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.facts import KEY
from sightline.plans.base import query
from sightline.plans.planning import HOUR, PLAN_TASKS, fnv_sql, plan_accounts
from sightline.sources.tables import FACTS_SQL, RUNS_SQL, facts_of, table
from sightline.sources.tables import runs as run_rows
from sightline.streaming import landing, runner, runs, switch, ticks, upserts

DAY_MS = 86_400_000
#: Days of events that land together, and rows of a landed file at the most.
SPAN, ROWS = 5, 5_000_000


@query("""SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def st_windowed_counts(spark, d):
    """Tumbling windows of a day over the events as a stream."""
    counted = upserts.windowed_counts(runner.events(spark, d, "events"), "ts", "event_type", "1 day", "2 days")
    return runner.finished(counted, "windows").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


BEST_SQL = f"""WITH {FACTS_SQL}, k AS (SELECT *, min(arrival) OVER w AS fact_id, row_number() OVER (PARTITION BY member_id, metric, period_key, source, observed_at ORDER BY confidence DESC, arrival) AS n FROM facts WINDOW w AS (PARTITION BY member_id, metric, period_key, source, observed_at)) SELECT member_id, metric, observed_at, source, value, arrival, fact_id FROM k WHERE n = 1"""


@query(BEST_SQL)
def st_best_readings(spark, d):
    """The confidence-guarded upsert as keyed state of a stream of lines."""
    best = upserts.best_readings(facts_of(runner.events(spark, d, "lineitem")))
    return runner.finished(best, "readings").select("member_id", "metric", "observed_at", "source", "value", "arrival", "fact_id")


def _landed(df: DataFrame, queue: str, batch: str, files: int | None = None) -> int:
    """Lands the rows of each batch number in turn, numbers from 0 without a gap in what is given; returns how many there are."""
    last = df.agg(F.max(batch)).first()[0]  # one row
    for k in range((-1 if last is None else last) + 1):
        landing.land(df.where(F.col(batch) == k).drop(batch), queue, files)
    return 0 if last is None else last + 1


@query(BEST_SQL)
def st_best_readings_in_batches(spark, d):
    """The same state over six batches of lines that come in the order of their observation, months late at most: keys leave the state once the watermark has passed them, and updates of each batch are kept under its number."""
    path = runner.scratch(spark, "updates")
    lines = facts_of(table(spark, d, "lineitem"))
    first, last = lines.agg(F.min("observed_at"), F.max("observed_at")).first()  # one row
    batch = F.floor(F.date_diff("observed_at", F.lit(first)) * 6 / (F.date_diff(F.lit(last), F.lit(first)) + 1)).cast("int")
    batch = F.when((F.col("arrival") % 11 == 0) & (batch < 5), batch + 1).otherwise(batch)  # some come a batch late
    _landed(lines.withColumn("k", batch), f"{path}/queue", "k")
    best = upserts.best_readings(landing.landed(spark, f"{path}/queue", lines.schema, 1), "900 days")
    keep = landing.keep(f"{path}/out", lambda rows, number: rows.withColumn("batch", F.lit(number)))
    landing.drained(best, keep, f"{path}/progress", "update")
    every = landing.committed(spark, f"{path}/out", best.withColumn("batch", F.lit(0)).schema)
    return upserts.newest_of(every, [*KEY, "observed_ts"]).select("member_id", "metric", "observed_at", "source", "value", "arrival", "fact_id")


@query("""SELECT event_id FROM events WHERE event_type = 'error'""")
def st_gated_events(spark, d):
    """A kill switch on a stream: errors pass while nothing is paused."""
    stream = runner.events(spark, d, "events").where("event_type = 'error'").select("event_id", F.col("user_id").alias("account_id"))
    path = runner.scratch(spark, "gated")
    switch.set_pause(spark, f"{path}/store", False)
    switch.set_accounts(table(spark, d, "events").select(F.col("user_id").alias("account_id"), F.lit(True).alias("enabled")).distinct(), f"{path}/store")
    held = switch.Switch(switch.stored(spark, f"{path}/store"), 2.0)
    landing.drained(stream, landing.keep(f"{path}/out", switch.judged(held, lambda _, number: float(number))), f"{path}/progress")
    return landing.committed(spark, f"{path}/out", "event_id long, account_id long, verdict string, why string").where("verdict = 'free'").select("event_id")


WAIT_MS, LATE_MS = 12 * 3_600_000, 6 * 3_600_000
TIMED_SQL = f"{RUNS_SQL}, e AS (SELECT *, started_at // 1000 AS ms FROM runs WHERE status <> 'paused'), m AS (SELECT max(ms) AS last FROM e)"


@query(f"""WITH {TIMED_SQL}, k AS (SELECT e.* FROM e, m WHERE NOT (event_id % 50 = 7 AND ms < last - {2 * DAY_MS})), n AS (SELECT *, lead(status) OVER w AS next, lead(ms) OVER w AS upto FROM k WINDOW w AS (PARTITION BY account_id, task ORDER BY ms, event_id)),
r AS (SELECT n.*, coalesce(upto <= last - {LATE_MS}, false) AS known, upto <= ms + {WAIT_MS} AND next <> 'running' AS timely, last - {LATE_MS} AS now FROM n, m WHERE status = 'running')
SELECT account_id, task, event_id AS run_id, ms AS started_ms, CASE WHEN known AND timely THEN next ELSE 'stale' END AS outcome, CASE WHEN known AND timely THEN upto END AS ended_ms FROM r WHERE ms <= now AND (known OR ms + {WAIT_MS} <= now)""")
def st_run_outcomes(spark, d):
    """Runs that finish, fail or go stale, from events that land in batches of five days, up to four hours out of order; one in fifty comes ten days late, behind the watermark, and is dropped. The stream stops after each batch and goes on from its checkpoint."""
    path = runner.scratch(spark, "runs")
    rows = run_rows(spark, d).where("status <> 'paused'").withColumn("ts", F.timestamp_micros("started_at"))
    first, last = rows.agg(F.min("started_at"), F.max("started_at")).first()  # one row
    slow = (F.col("event_id") % 50 == 7) & (F.col("started_at") < last - 2000 * DAY_MS)
    arrival = F.col("started_at") + F.when(slow, 2 * SPAN * 1000 * DAY_MS + 1000 * DAY_MS).otherwise(F.col("event_id") % 5 * 3_600_000_000)
    rows = rows.withColumn("k", F.floor((arrival - first) / (SPAN * 1000 * DAY_MS)).cast("int"))
    schema = rows.drop("k").schema
    with runs.with_timers(spark):
        for k in range(rows.agg(F.max("k")).first()[0] + 1):
            landing.land(rows.where(F.col("k") == k).drop("k"), f"{path}/queue")
            landing.drained(runs.run_outcomes(landing.landed(spark, f"{path}/queue", schema), WAIT_MS, f"{LATE_MS} milliseconds"), landing.keep(f"{path}/out"), f"{path}/progress")
    return landing.committed(spark, f"{path}/out", runs.OUTCOME)


@query(f"""WITH {FACTS_SQL} SELECT member_id, metric, period_key, observed_at, source, value, confidence, arrival FROM facts""")
def st_queue_ingest(spark, d):
    """Captures that land in a queue, parsed and kept exactly once: a batch breaks off after it was written, and is run again."""
    path = runner.scratch(spark, "ingest")
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_shipdate", "l_linestatus", "l_extendedprice", "l_discount", "l_orderkey", "l_linenumber")
    _landed(lines.withColumn("k", (F.col("l_linenumber") % 3).cast("int")), f"{path}/queue", "k")
    stream = landing.landed(spark, f"{path}/queue", lines.schema, 2)
    keep = landing.keep(f"{path}/out", lambda rows, _: facts_of(rows))
    broken = []

    def sink(rows, number):
        keep(rows, number)
        if not broken:
            broken.append(number)
            raise ConnectionError("the driver goes away after the write, before the stream notes the batch")

    try:
        landing.drained(stream, sink, f"{path}/progress")
    except Exception:  # noqa: BLE001  as meant; what is broken is the first batch alone
        if not broken:
            raise
    landing.drained(stream, sink, f"{path}/progress")
    return landing.committed(spark, f"{path}/out", facts_of(lines).schema)


PAUSE_DAYS, TTL_DAYS = 3, 4


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, (epoch_us(ts) // 1000 - (SELECT min(epoch_us(ts) // 1000) FROM events)) // {PAUSE_DAYS * DAY_MS} AS k FROM events),
f AS (SELECT k + 1 AS since, count(*) FILTER (event_type = 'error') % 2 = 1 AS paused FROM e GROUP BY k)
SELECT event_id, CASE WHEN f.paused THEN 'paused' WHEN user_id % 7 = 0 THEN 'disabled' ELSE 'free' END AS verdict FROM e LEFT JOIN f ON since = e.k - e.k % 2""")
def st_kill_switch(spark, d):
    """A flag that is set between the batches of a stream, of three days each: with a time to live of four days it takes effect with every second batch."""
    path = runner.scratch(spark, "switch")
    span = PAUSE_DAYS * DAY_MS
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("account_id"), "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    first, n = rows.agg(F.min("ms"), F.count("*")).first()  # one row
    rows = rows.withColumn("k", F.floor((F.col("ms") - first) / span).cast("int"))
    files = max(1, n // ROWS)
    batches = _landed(rows, f"{path}/queue", "k", files)
    odd = {r.k: r.n % 2 == 1 for r in rows.groupBy("k").agg(F.count_if(F.col("event_type") == "error").alias("n")).collect()}  # a row for each batch
    store = f"{path}/store"
    switch.set_accounts(rows.select("account_id", (F.col("account_id") % 7 != 0).alias("enabled")).distinct(), store)
    held = switch.Switch(switch.stored(spark, store), float(TTL_DAYS * DAY_MS))
    judge = landing.keep(f"{path}/out", switch.judged(held, lambda _, number: float(number * span)))

    def sink(batch, number):
        switch.set_pause(spark, store, odd.get(number - 1, False), "too many errors")
        judge(batch, number)

    landing.drained(landing.landed(spark, f"{path}/queue", rows.drop("k").schema, files), sink, f"{path}/progress")
    assert len(landing.folders(spark, f"{path}/out")) == batches
    return landing.committed(spark, f"{path}/out", "event_id long, verdict string").select("event_id", "verdict")


TICKS = 5
_JITTER = fnv_sql("CAST(p.account_id AS VARCHAR)", "p.task", "CAST(coalesce(p.last_ns, 0) AS VARCHAR)")
_OFFLINE = fnv_sql("CAST(account_id AS VARCHAR)", "strftime(make_timestamp(moment) - to_days(back), '%Y-%m-%d')")


def _tick_sql() -> str:
    """Each tick as a common table of its own: the state is the one before with its pick's last run moved to the tick."""
    parts = [f"""WITH {RUNS_SQL}, t(task, cadence, role) AS (VALUES ('task0', {6 * HOUR}, 'main'), ('task0', {6 * HOUR}, 'farm'), ('task1', {200 * HOUR}, 'main'), ('task3', {30 * HOUR}, 'farm')),
z AS (SELECT max(started_at) AS last FROM runs), a AS (SELECT DISTINCT account_id, CASE WHEN account_id % 2 = 0 THEN 'main' ELSE 'farm' END AS role FROM runs WHERE account_id % 7 <> 0),
w AS (SELECT account_id, i, {_OFFLINE} AS h, (moment - epoch_us(date_trunc('day', make_timestamp(moment)))) / 60e6 + 1440 * back AS minute FROM (SELECT account_id, i, last + 3600000000 * i AS moment, back FROM a, z, range(1, {TICKS + 1}) r(i), (VALUES (0), (1)) b(back))),
awake AS (SELECT account_id, i FROM w GROUP BY 1, 2 HAVING NOT bool_or(minute >= CAST(h % 1440 AS INTEGER) AND minute < CAST(h % 1440 AS INTEGER) + CAST(300 + (h // 1440) % 121 AS INTEGER))),
l AS (SELECT account_id, task, max(started_at) FILTER (status IN ('succeeded', 'failed')) AS last_run, max(started_at) FILTER (status = 'succeeded') AS ok FROM runs WHERE task <> 'task2' GROUP BY 1, 2),
s0 AS (SELECT a.account_id, t.task, t.cadence, l.last_run * 1000 AS last_ns, (SELECT count(*) FROM runs r WHERE r.account_id = l.account_id AND r.task = l.task AND r.status = 'failed' AND (l.ok IS NULL OR r.started_at > l.ok)) AS failures FROM a JOIN t USING (role) LEFT JOIN l ON l.account_id = a.account_id AND l.task = t.task)"""]
    for i in range(1, TICKS + 1):
        now = f"(SELECT (last + {i} * 3600000000) * 1000 FROM z)"
        parts.append(f"""d{i} AS (SELECT p.account_id, p.task, {now} - CASE WHEN p.last_ns IS NULL THEN {now} ELSE p.last_ns + p.cadence + CAST(trunc((({_JITTER} % 40001)::DOUBLE / 40000.0::DOUBLE * 0.4::DOUBLE - 0.2::DOUBLE) * p.cadence::DOUBLE) AS BIGINT) + CASE WHEN p.failures <= 0 THEN 0 ELSE p.cadence * (CAST(pow(2, least(p.failures, 5)) AS BIGINT) - 1) END END AS overdue FROM s{i - 1} p JOIN awake ON awake.account_id = p.account_id AND awake.i = {i}),
x{i} AS MATERIALIZED (SELECT account_id, task FROM d{i} WHERE overdue >= 0 ORDER BY overdue DESC, task, account_id LIMIT 1),
s{i} AS MATERIALIZED (SELECT p.account_id, p.task, p.cadence, CASE WHEN x.task IS NULL THEN p.last_ns ELSE {now} END AS last_ns, CASE WHEN x.task IS NULL THEN p.failures WHEN p.task = 'task0' THEN p.failures + 1 ELSE 0 END AS failures FROM s{i - 1} p LEFT JOIN x{i} x ON x.account_id = p.account_id AND x.task = p.task)""")
    picks = " UNION ALL ".join(f"SELECT account_id, task, CASE WHEN task = 'task0' THEN 'failed' ELSE 'succeeded' END AS status, (SELECT last FROM z) + {i} * 3600000000 AS started_at FROM x{i}" for i in range(1, TICKS + 1))
    return ",\n".join(parts) + "\n" + picks


@query(_tick_sql())
def st_tick_loop(spark, d):
    """Hourly ticks after the last event: each runs the pair that is most overdue, and the next sees that run. task0 always fails, so it backs off."""
    path = runner.scratch(spark, "ticks")
    rows = run_rows(spark, d)
    last = rows.agg(F.max("started_at")).first()[0]  # one row
    if last is None:
        return ticks.ticked(spark, f"{path}/runs").drop("error")
    for i in range(1, TICKS + 1):
        landing.land(spark.range(1).select(F.timestamp_micros(F.lit(last + i * 3_600_000_000)).alias("tick")), f"{path}/queue", 1)

    def execute(_: int, task: str) -> None:
        if task == "task0":
            raise RuntimeError("the screen was not recognised")

    loop = ticks.ticking(f"{path}/runs", plan_accounts(rows), spark.createDataFrame(*PLAN_TASKS), lambda: rows.where("task <> 'task2'"), execute)
    landing.drained(landing.landed(spark, f"{path}/queue", "tick timestamp", 1), loop, f"{path}/progress")
    return ticks.ticked(spark, f"{path}/runs").drop("error")
