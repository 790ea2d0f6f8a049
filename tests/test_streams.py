"""Streams that break off, come late and go on, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import facts
from sightline.streaming import landing, runs, switch, ticks, upserts

EVENTS = "event_id long, account_id long, task string, status string, ms long"
HOUR = 3_600_000


def outcomes(rows, wait, now):
    """What becomes of each run, by looking at all events at once."""
    out = set()
    by = {}
    for e in sorted((r for r in rows if r[3] in ("running", "succeeded", "failed")), key=lambda r: (r[4], r[0])):
        by.setdefault((e[1], e[2]), []).append(e)
    for (account, task), es in by.items():
        for k, e in enumerate(es):
            after = es[k + 1] if k + 1 < len(es) and es[k + 1][4] <= now else None
            if e[3] != "running" or e[4] > now or after is None and e[4] + wait > now:
                continue
            timely = after is not None and after[3] != "running" and after[4] <= e[4] + wait
            out.add((account, task, e[0], e[4], after[3] if timely else "stale", after[4] if timely else None))
    return out


@pytest.fixture(scope="module")
def events():
    r = random.Random(3)
    return [(i, r.randrange(4), f"t{r.randrange(2)}", r.choice(["running", "running", "succeeded", "failed", "paused"]), r.randrange(100 * HOUR)) for i in range(160)]


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENTS).withColumn("ts", F.timestamp_millis("ms")).drop("ms")


def run_stream(spark, path, late="8 hours"):
    schema = frame(spark, []).schema
    landing.drained(runs.run_outcomes(landing.landed(spark, f"{path}/queue", schema), 6 * HOUR, late), landing.keep(f"{path}/out"), f"{path}/progress")


def found(spark, path):
    rows = [tuple(r) for r in landing.committed(spark, f"{path}/out", runs.OUTCOME).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_run_outcomes_over_batches_with_restarts(spark, tmp_path, events):
    """Events up to eight hours out of order, a restart between any two batches: the outcomes are those of the whole."""
    r = random.Random(1)
    ordered = sorted(events, key=lambda e: e[4] + r.randrange(7 * HOUR))
    with runs.with_timers(spark):
        for k in range(0, len(ordered), 40):
            landing.land(frame(spark, ordered[k : k + 40]), f"{tmp_path}/queue")
            run_stream(spark, str(tmp_path))
    now = max(e[4] for e in events) - 8 * HOUR
    assert found(spark, str(tmp_path)) == outcomes(events, 6 * HOUR, now)


def test_late_events_are_dropped_and_stale_runs_end(spark, tmp_path):
    on_time = [(1, 1, "t", "running", 10 * HOUR), (2, 2, "t", "running", 10 * HOUR), (3, 2, "t", "succeeded", 11 * HOUR), (4, 3, "t", "running", 60 * HOUR)]
    late = [(5, 1, "t", "succeeded", 11 * HOUR), (6, 9, "t", "running", 90 * HOUR)]
    with runs.with_timers(spark):
        for part in (on_time, [(7, 8, "t", "failed", 80 * HOUR)], late):
            landing.land(frame(spark, part), f"{tmp_path}/queue")
            run_stream(spark, str(tmp_path), "1 hour")
    assert found(spark, str(tmp_path)) == {(1, "t", 1, 10 * HOUR, "stale", None), (2, "t", 2, 10 * HOUR, "succeeded", 11 * HOUR), (3, "t", 4, 60 * HOUR, "stale", None)}


@pytest.mark.parametrize("when", ["before the write", "after the write"])
def test_a_killed_batch_is_neither_doubled_nor_lost(spark, tmp_path, when):
    path = str(tmp_path)
    for k in range(3):
        landing.land(spark.range(10 * k, 10 * k + 10), f"{path}/queue", 1)
    keep, killed = landing.keep(f"{path}/out", lambda rows, _: rows.withColumn("twice", F.col("id") * 2)), []

    def sink(rows, number):
        if when == "after the write":
            keep(rows, number)
        if number == 1 and not killed:
            killed.append(number)
            raise KeyError("killed")
        keep(rows, number)

    stream = landing.landed(spark, f"{path}/queue", "id long", 1)
    with pytest.raises(Exception, match="killed"):
        landing.drained(stream, sink, f"{path}/progress")
    landing.drained(stream, sink, f"{path}/progress")
    landing.drained(stream, sink, f"{path}/progress")
    assert sorted(tuple(r) for r in landing.committed(spark, f"{path}/out", "id long, twice long").collect()) == [(i, 2 * i) for i in range(30)]
    # what a broken write leaves is not read
    (tmp_path / "out" / "000000000009").mkdir()
    (tmp_path / "out" / "000000000009" / "part-0.parquet").write_bytes(b"half")
    assert landing.committed(spark, f"{path}/out", "id long, twice long").count() == 30
    assert landing.committed(spark, f"{path}/none", "id long").count() == 0


def test_best_readings_leave_the_state(spark, tmp_path):
    """Readings of fifty days in five batches, ties and later, better ones among them: the last update of each key is the upsert of the whole, and keys that the watermark has passed are held no more."""
    r = random.Random(5)
    rows = [(i % 3, "m", "p", "s", f"2024-{1 + i // 40:02d}-{1 + i // 4 % 10:02d}", float(i), r.choice([0.1, 0.5, 0.9]), i) for i in range(200)]
    schema = "member_id int, metric string, period_key string, source string, observed_at string, value double, confidence double, arrival int"
    for k in range(5):
        landing.land(spark.createDataFrame(rows[k * 40 : k * 40 + 40], schema), f"{tmp_path}/queue", 1)
    best = upserts.best_readings(landing.landed(spark, f"{tmp_path}/queue", schema, 1), "10 days")
    keep = landing.keep(f"{tmp_path}/out", lambda b, n: b.withColumn("batch", F.lit(n)))
    q = best.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    got = upserts.newest_of(landing.committed(spark, f"{tmp_path}/out", best.withColumn("batch", F.lit(0)).schema), [*facts.KEY, "observed_ts"])
    want = facts.upsert(spark.createDataFrame(rows, schema))
    read = lambda df: sorted((x.member_id, x.observed_at, x.value, x.arrival, x.fact_id) for x in df.collect())
    assert read(got) == read(want) and max(held) < want.count()


def test_switch_holds_for_its_time_and_fails_closed(spark, tmp_path):
    store = f"{tmp_path}/store"
    rows = spark.createDataFrame([(1,), (2,), (3,)], "account_id long")
    verdicts = lambda held, now: {x.account_id: (x.verdict, x.why) for x in held.judge(rows, now).collect()}
    held = switch.Switch(switch.stored(spark, store), 10.0)
    assert {v for v, _ in verdicts(held, 0.0).values()} == {"unreadable"}
    switch.set_accounts(spark.createDataFrame([(1, True), (2, False)], "account_id long, enabled boolean"), store)
    switch.set_pause(spark, store, False)
    free = {1: ("free", None), 2: ("disabled", None), 3: ("unknown", None)}
    assert verdicts(held, 1.0) == free  # an unreadable state isn't held
    switch.set_pause(spark, store, True, "event")
    assert verdicts(held, 11.0) == free
    assert set(verdicts(held, 11.5).values()) == {("paused", "event")}
    broken = switch.Switch(lambda now: 1 / 0 if now > 20 else ((False, ""), spark.createDataFrame([(1, True)], "account_id long, enabled boolean")), 0.0)
    assert verdicts(broken, 15.0)[1] == ("free", None) and {v for v, _ in verdicts(broken, 21.0).values()} == {"unreadable"}


ACCOUNTS = [(1, "main", True), (2, "main", True)]
TASKS = [("a", 90 * 10**9, ["main"], list(range(7)), True), ("b", 10**15, ["main"], list(range(7)), True)]


def tick(spark, path, number, history, **how):
    accounts = spark.createDataFrame(ACCOUNTS, "account_id long, role string, enabled boolean")
    tasks = spark.createDataFrame(TASKS, "task string, cadence_ns long, roles array<string>, days array<int>, enabled boolean")
    ticks.ticking(path, accounts, tasks, history, **how)(spark.sql(f"SELECT timestamp'2024-03-05 23:5{number}:00' AS tick"), number)
    return [(r.account_id, r.task, r.status) for r in ticks.ticked(spark, path).orderBy("started_at").collect()]


def test_ticks_see_what_ticks_before_left(spark, tmp_path, monkeypatch):
    from sightline.functions import schedule

    monkeypatch.setattr(schedule, "offline", lambda account, now: F.lit(False))
    none = lambda: spark.createDataFrame([], "account_id long, task string, status string, started_at long")
    path, done = f"{tmp_path}/runs", []

    def execute(account, task):
        done.append((account, task))
        if (account, task) == (2, "a"):
            raise OSError("boom")

    for k in range(4):
        tick(spark, path, k, none, execute=execute)
    assert done == [(1, "a"), (2, "a"), (1, "a"), (1, "b")]  # what failed is put off for twice its cadence
    got = tick(spark, path, 3, none, execute=execute)  # run again: it sees what it saw before
    assert done[4] == done[3] and len(got) == 4 and got[1] == (2, "a", "failed")
    assert len(tick(spark, path, 4, none, paused=lambda: True)) == 4

    def unreadable():
        raise ConnectionError("the store is down")

    assert len(tick(spark, path, 5, unreadable)) == 4 and len(tick(spark, path, 6, none)) == 5


def test_commands_pause_resume_and_land(spark, tmp_path, capsys):
    from sightline.__main__ import main

    store = f"{tmp_path}/store"
    switch.set_accounts(spark.createDataFrame([(1, True)], "account_id long, enabled boolean"), store)
    held = switch.Switch(switch.stored(spark, store), -1.0)
    verdict = lambda: held.judge(spark.createDataFrame([(1,)], "account_id long"), 0.0).first()
    assert main(["pause", store, "--reason", "event"]) == 0 and (verdict().verdict, verdict().why) == ("paused", "event")
    assert main(["resume", store]) == 0 and verdict().verdict == "free"
    spark.range(3).write.parquet(f"{tmp_path}/captures")
    assert main(["land", f"{tmp_path}/captures", f"{tmp_path}/queue"]) == 0
    assert landing.folders(spark, f"{tmp_path}/queue") == ["000000000000"] and capsys.readouterr().out.startswith("paused\nrunning\n")
