"""What is due, and the hashes behind it, over users as accounts and their events as runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import schedule
from sightline.operators import planner
from sightline.plans.base import query
from sightline.sources.tables import RUNS_SQL, table
from sightline.sources.tables import runs as run_rows

HOUR = 3_600_000_000_000


def fnv_sql(*parts: str) -> str:
    """FNV-1a of ASCII strings, each ended by a zero byte, in DuckDB's 128-bit integers."""
    each = " || ".join(f"list_transform(range(1, length({p}) + 1), lambda i: ascii(({p})[i])) || [0]" for p in parts)
    return f"list_reduce(list_transform({each}, lambda x: x::UHUGEINT), lambda h, b: (xor(h, b) * {schedule.PRIME}::UHUGEINT) % {schedule.WORD}::UHUGEINT, {schedule.OFFSET}::UHUGEINT)"


@query(f"""SELECT c_custkey, CAST({fnv_sql("CAST(c_custkey AS VARCHAR)", "c_mktsegment")} AS VARCHAR) AS hash FROM customer""")
def f_fnv_hashes(spark, d):
    return table(spark, d, "customer").select("c_custkey", schedule.number(schedule.fnv1a(F.col("c_custkey").cast("string"), F.col("c_mktsegment"))).cast("string").alias("hash"))


WINDOW_SQL = "WITH h AS (SELECT c_custkey AS account_id, day, {h} AS h FROM customer, (VALUES ('2026-08-17'), ('2026-08-18')) t(day))".format(h=fnv_sql("CAST(c_custkey AS VARCHAR)", "day"))


@query(f"""{WINDOW_SQL} SELECT account_id, day, CAST(h % 1440 AS INTEGER) AS start, CAST(300 + (h // 1440) % 121 AS INTEGER) AS minutes FROM h""")
def f_off_windows(spark, d):
    days = spark.createDataFrame([("2026-08-17",), ("2026-08-18",)], "day string")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("account_id")).join(F.broadcast(days))
    return c.select("account_id", "day", schedule.offline_minutes(F.col("account_id"), F.col("day")).alias("w")).select("account_id", "day", "w.*")


@query(f"""{WINDOW_SQL}, w AS (SELECT account_id, day, CAST(h % 1440 AS INTEGER) AS s, CAST(300 + (h // 1440) % 121 AS INTEGER) AS m FROM h) SELECT account_id, bool_or(CASE WHEN day = '2026-08-18' THEN 100 >= s AND 100 < s + m ELSE 1540 >= s AND 1540 < s + m END) AS offline FROM w GROUP BY 1""")
def p_off_resting(spark, d):
    """Who rests at 01:40 on a Tuesday, by that day's window or the one before."""
    now = F.lit("2026-08-18 01:40:00").cast("timestamp")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("account_id"), schedule.offline(F.col("c_custkey"), now).alias("offline"))


@query(f"""WITH j AS (SELECT c_custkey, {fnv_sql("CAST(c_custkey AS VARCHAR)", "c_mktsegment", "CAST(c_custkey * 1000000007 AS VARCHAR)")} AS h FROM customer) SELECT c_custkey, CAST(trunc(((h % 40001)::DOUBLE / 40000.0::DOUBLE * 0.4::DOUBLE - 0.2::DOUBLE) * {HOUR}::DOUBLE) AS BIGINT) AS jitter FROM j""")
def f_jit_cadence_offsets(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", schedule.cadence_offset(F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_custkey") * 1_000_000_007, F.lit(HOUR)).alias("jitter"))


_EVERY = list(range(7))
#: Tasks of the plan: rows and schema.
PLAN_TASKS = ([("task0", 6 * HOUR, ["main", "farm", "main"], _EVERY, True), ("task1", 200 * HOUR, ["main"], _EVERY, True), ("task2", HOUR, ["farm"], _EVERY, False), ("task3", 30 * HOUR, ["farm"], _EVERY, True), ("task4", HOUR, ["farm"], [], True)], "task string, cadence_ns long, roles array<string>, days array<int>, enabled boolean")


def plan_accounts(runs):
    """Users are accounts, of the role that their number gives."""
    return runs.select("account_id").distinct().select("account_id", F.when(F.col("account_id") % 2 == 0, "main").otherwise("farm").alias("role"), (F.col("account_id") % 7 != 0).alias("enabled"))


def _plan(spark, d):
    """The moment is two hours after the last event."""
    runs = run_rows(spark, d)
    state = planner.run_state(runs.where("task <> 'task2'")).select("account_id", "task", (F.col("last_run") * 1000).alias("last_ns"), "failures")
    end = runs.agg(F.max("started_at")).first()[0]  # one row
    now = F.timestamp_micros(F.lit(end + 7_200_000_000))
    return planner.due_work(plan_accounts(runs), spark.createDataFrame(*PLAN_TASKS), state, now)


PLAN_SQL = f"""WITH {RUNS_SQL}, t(task, cadence, role) AS (VALUES ('task0', {6 * HOUR}, 'main'), ('task0', {6 * HOUR}, 'farm'), ('task1', {200 * HOUR}, 'main'), ('task3', {30 * HOUR}, 'farm')),
e AS (SELECT max(started_at) + 7200000000 AS now FROM runs), a AS (SELECT DISTINCT account_id, CASE WHEN account_id % 2 = 0 THEN 'main' ELSE 'farm' END AS role FROM runs WHERE account_id % 7 <> 0),
w AS (SELECT account_id, back, {fnv_sql("CAST(account_id AS VARCHAR)", "strftime(make_timestamp(now) - to_days(back), '%Y-%m-%d')")} AS h, (now - epoch_us(date_trunc('day', make_timestamp(now)))) / 60e6 + 1440 * back AS minute FROM a, e, (VALUES (0), (1)) b(back)),
awake AS (SELECT account_id FROM w GROUP BY 1 HAVING NOT bool_or(minute >= CAST(h % 1440 AS INTEGER) AND minute < CAST(h % 1440 AS INTEGER) + CAST(300 + (h // 1440) % 121 AS INTEGER))),
l AS (SELECT account_id, task, max(started_at) FILTER (status IN ('succeeded', 'failed')) AS last_run, max(started_at) FILTER (status = 'succeeded') AS ok FROM runs WHERE task <> 'task2' GROUP BY 1, 2),
s AS (SELECT *, (SELECT count(*) FROM runs r WHERE r.account_id = l.account_id AND r.task = l.task AND r.status = 'failed' AND (l.ok IS NULL OR r.started_at > l.ok)) AS failures FROM l),
p AS (SELECT a.account_id, t.task, t.cadence, s.last_run * 1000 AS last_ns, coalesce(failures, 0) AS failures, now * 1000 AS now FROM a JOIN awake USING (account_id) JOIN t USING (role) LEFT JOIN s ON s.account_id = a.account_id AND s.task = t.task, e),
due AS (SELECT account_id, task, now - CASE WHEN last_ns IS NULL THEN now ELSE last_ns + cadence + CAST(trunc((({fnv_sql("CAST(account_id AS VARCHAR)", "task", "CAST(coalesce(last_ns, 0) AS VARCHAR)")} % 40001)::DOUBLE / 40000.0::DOUBLE * 0.4::DOUBLE - 0.2::DOUBLE) * cadence::DOUBLE) AS BIGINT) + CASE WHEN failures <= 0 THEN 0 ELSE cadence * (CAST(pow(2, least(failures, 5)) AS BIGINT) - 1) END END AS overdue FROM p)
SELECT account_id, task, overdue FROM due WHERE overdue >= 0"""


@query(PLAN_SQL)
def j_plan_due_work(spark, d):
    """J-PLAN with P-ROLE, P-DOW, P-OFF, F-JIT, F-BKO and F-DUE."""
    return _plan(spark, d)


@query(f"{PLAN_SQL} ORDER BY overdue DESC, task, account_id LIMIT 1")
def o_plan_first_due(spark, d):
    return planner.first_due(_plan(spark, d))
