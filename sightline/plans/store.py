"""Store operations over the driver's tables: a supplier is an alliance, a customer a member or account, an order a capture or review, a line a frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import store
from sightline.plans.base import query
from sightline.sources.tables import table


@query("""SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_name = 'Supplier#000000003' AND s_nationkey >= 0""")
def p_pt_lookup(spark, d):
    """One alliance by its name; the test holds that a missing one raises."""
    s = table(spark, d, "supplier")
    return store.lookup(s, (F.col("s_name") == "Supplier#000000003") & (F.col("s_nationkey") >= 0)).select("s_suppkey", "s_name", "s_acctbal")


@query("""SELECT user_id, nullif(CASE WHEN event_type = 'error' THEN '' ELSE event_type END, '') AS kind, nullif(CAST(floor(value) AS BIGINT) % 4, 0) AS rest, event_id FROM events""")
def p_nul_sentinels(spark, d):
    ev = table(spark, d, "events")
    return ev.select("user_id", store.null_if_blank(F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))).alias("kind"), F.nullif(F.floor("value") % 4, F.lit(0)).alias("rest"), "event_id")


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 7 AND c_acctbal > 0 ORDER BY lower(c_name), c_custkey""")
def p_act_active_members(spark, d):
    c = table(spark, d, "customer").where("c_nationkey = 7 and c_acctbal > 0")
    return store.ordered(c, F.lower("c_name"), "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query("""SELECT o_orderkey AS review_id, epoch(o_orderdate)::BIGINT AS created FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey""")
def p_pend_reviews(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'O'")
    return store.ordered(o, "o_orderdate", "o_orderkey").select(F.col("o_orderkey").alias("review_id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created"))


@query("""SELECT l_orderkey AS capture_id, l_linenumber AS seq, l_suppkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey ORDER BY capture_id, seq, l_suppkey, p_name""")
def j_frs_frames_in_order(spark, d):
    """P-FRM and J-FRS: frames of captures with their screenshots, in scroll order."""
    li = table(spark, d, "lineitem")
    rows = li.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("capture_id"), F.col("l_linenumber").alias("seq"), "l_suppkey", "p_name")
    return store.ordered(rows, "capture_id", "seq", "l_suppkey", "p_name")


def _chain(spark, d):
    accounts = table(spark, d, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_nationkey").alias("instance_id"), (F.col("c_acctbal") > 0).alias("enabled"))
    instances = table(spark, d, "nation").select(F.col("n_nationkey").alias("instance_id"), F.col("n_regionkey").alias("device_id"), F.col("n_name").alias("clone"))
    return accounts, instances, table(spark, d, "region").select(F.col("r_regionkey").alias("device_id"), F.col("r_name").alias("serial"))


@query("""SELECT c_custkey AS account_id, r_name AS serial, n_name AS clone FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey ORDER BY serial, clone, account_id""")
def j_lst_accounts(spark, d):
    return store.ordered(store.chain(*_chain(spark, d)), "serial", "clone", "account_id").select("account_id", "serial", "clone")


@query("""SELECT c_custkey AS account_id, r_name AS serial, n_name AS clone FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AFRICA', 'ASIA')""")
def j_sch_accounts_of_serials(spark, d):
    return store.chain(*_chain(spark, d), ["AFRICA", "ASIA"]).select("account_id", "serial", "clone")


@query("""SELECT c_custkey AS account_id, CASE WHEN f.paused AND c_custkey % 11 = 0 THEN 'paused' WHEN NOT c_acctbal > 0 THEN 'disabled' ELSE 'ok' END AS state FROM customer, (SELECT max(r_regionkey) = 4 AS paused FROM region) f""")
def j_kill_state(spark, d):
    """J-KILL, P-KILL and O-PAU: accounts under the one row of flags, which a pause has set for every eleventh."""
    accounts, _, devices = _chain(spark, d)
    flags = devices.agg((F.max("device_id") == 4).alias("paused"))
    return store.with_flags(accounts, flags).select("account_id", store.kill_state(F.col("paused") & (F.col("account_id") % 11 == 0), F.col("enabled")).alias("state"))


@query("""SELECT event_type, CASE WHEN event_type = 'purchase' THEN 'succeeded' WHEN event_type IN ('view', 'signup') THEN 'paused' ELSE 'failed' END AS status, count(*) AS n FROM events GROUP BY ALL""")
def p_stat_run_outcomes(spark, d):
    error = F.when(F.col("event_type") == "view", "paused").when(F.col("event_type") == "signup", "account disabled").when(F.col("event_type") != "purchase", F.concat(F.lit("task: "), F.col("event_type")))
    return table(spark, d, "events").groupBy("event_type", store.run_outcome(error).alias("status")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT l_orderkey AS k, l_linenumber AS i FROM lineitem WHERE l_tax > 0.04), o AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS i FROM lineitem WHERE l_tax < 0.02) SELECT n.k, n.i, count(*) OVER (PARTITION BY n.k, n.i) > 1 OR o.k IS NOT NULL AS conflict FROM n LEFT JOIN o ON n.k = o.k AND n.i = o.i""")
def o_ins_conflicts(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), "l_tax")
    return store.insert_new(li.where("l_tax < 0.02"), li.where("l_tax > 0.04").drop("l_tax"), ["k", "i"])


@query("""WITH c AS (SELECT o_custkey AS k, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1), n AS (SELECT k + CASE WHEN k % 13 = 0 THEN 10000000 ELSE 0 END AS k, status FROM c) SELECT coalesce(c_custkey, k) AS k, c_name AS name, CASE WHEN c_custkey IS NOT NULL THEN coalesce(status, c_mktsegment) END AS status, c_custkey IS NOT NULL AS found FROM customer FULL JOIN n ON c_custkey = k""")
def o_set_updates(spark, d):
    """Members get a new status by id; every thirteenth change asks for an id that isn't there."""
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    changes = last.withColumn("k", F.col("k") + F.when(F.col("k") % 13 == 0, 10_000_000).otherwise(0))
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"))
    return store.update(members, changes, "k", ["status"])


@query("""WITH n AS (SELECT o_custkey AS k, count(*) AS member_count, max(epoch(o_orderdate)::BIGINT) AS observed_at FROM orders GROUP BY 1), o AS (SELECT c_custkey AS k, c_mktsegment AS server, 0 AS member_count, 0 AS observed_at FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NOT NULL THEN o.server ELSE 'new' END AS server, coalesce(n.member_count, o.member_count) AS member_count, coalesce(n.observed_at, o.observed_at) AS observed_at FROM o FULL JOIN n ON o.k = n.k""")
def o_ual_alliance_upsert(spark, d):
    """O-UAL and API-5: a refresh takes count and time, and keeps the server."""
    old = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("server"), F.lit(0).cast("long").alias("member_count"), F.lit(0).cast("long").alias("observed_at"))
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.lit("new").alias("server"), F.count("*").alias("member_count"), F.max(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("observed_at"))
    return store.refresh_latest(old, new, ["k"], ["member_count", "observed_at"], "observed_at")


@query("""WITH f AS (SELECT l_orderkey AS run_id, arg_min(l_returnflag, (l_shipdate, l_returnflag)) AS status, min(epoch(l_shipdate)::BIGINT) AS ended_at FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) SELECT o_orderkey AS run_id, epoch(o_orderdate)::BIGINT AS started_at, coalesce(f.status, 'running') AS status, f.ended_at FROM orders LEFT JOIN f ON o_orderkey = run_id""")
def o_trn_runs(spark, d):
    """A run is an order, its finishes are lines."""
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    starts = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), at("o_orderdate").alias("started_at"))
    finishes = table(spark, d, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("status"), at("l_shipdate").alias("ended_at"))
    return store.fold_runs(starts, finishes)


@query("""SELECT o_orderpriority AS task, max(d) AS longest, round(avg(d), 6) AS mean, count(*) AS n FROM (SELECT o_orderpriority, max(epoch(l_shipdate)::BIGINT) - epoch(o_orderdate)::BIGINT AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate) GROUP BY 1""")
def a_dur_run_times(spark, d):
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    ends = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(at("l_shipdate")).alias("ended_at"))
    runs = table(spark, d, "orders").join(ends, "o_orderkey").select(F.col("o_orderpriority").alias("task"), at("o_orderdate").alias("started_at"), "ended_at")
    return store.durations(runs, "task")


@query("""SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_orderstatus = 'P' AND epoch(o_orderdate)::BIGINT < (SELECT max(epoch(o_orderdate)::BIGINT) FROM orders) - 86400 * 300) AS stuck FROM orders GROUP BY 1""")
def a_sts_by_status(spark, d):
    """Counts by status, and how many of the running ones have run for more than 300 days."""
    o = table(spark, d, "orders").select("o_orderstatus", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"))
    now = o.agg(F.max("at").alias("now"))
    old = store.stuck(F.when(F.col("o_orderstatus") == "P", "running"), F.col("at"), F.col("now"), 86_400 * 300)
    return o.join(F.broadcast(now)).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(old).alias("stuck"))


@query("""SELECT o_orderkey AS capture_id FROM orders WHERE o_orderstatus <> 'F'""")
def o_del_cascade(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("capture_id"), "o_orderstatus")
    left, _ = store.delete_cascade(o, table(spark, d, "lineitem"), o.where("o_orderstatus = 'F'"), "capture_id", "l_orderkey")
    return left.select("capture_id")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def o_del_frames(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("capture_id"), "o_orderstatus")
    _, left = store.delete_cascade(o, table(spark, d, "lineitem"), o.where("o_orderstatus = 'F'"), "capture_id", "l_orderkey")
    return left.select("l_orderkey", "l_linenumber")


@query("""WITH f AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_linenumber) AS distinct_n, min(l_linenumber) - 1 AS lo, max(l_linenumber) - 1 AS hi FROM lineitem GROUP BY 1) SELECT o_orderkey AS capture_id, CASE WHEN o_orderstatus = 'F' THEN 'complete' ELSE 'partial' END AS status, coalesce(n, 0) AS frames, coalesce(n = distinct_n AND lo = 0 AND hi = n - 1, false) AS sound FROM orders LEFT JOIN f ON o_orderkey = k""")
def o_rcp_record_captures(spark, d):
    captures = table(spark, d, "orders").select(F.col("o_orderkey").alias("capture_id"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("partial").alias("status"))
    return store.record_capture(captures, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("capture_id"), (F.col("l_linenumber") - 1).alias("seq")))


@query("""WITH c AS (SELECT l_orderkey AS k, l_suppkey AS m, CAST(max(l_quantity) AS BIGINT) AS s FROM lineitem GROUP BY ALL), j AS (SELECT k, '[' || string_agg('{"member_id":' || m || ',"name":"' || s_name || '","score":' || s || '}', ',' ORDER BY s DESC, m) || ']' AS j FROM c JOIN supplier ON m = s_suppkey GROUP BY k) SELECT o_orderkey AS review_id, nullif(CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE 0.5 END, 0)::DOUBLE AS confidence, coalesce(j, '[]') AS candidates_json FROM orders LEFT JOIN j ON o_orderkey = k""")
def o_qrv_queue_reviews(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"), F.when(F.col("o_orderkey") % 4 == 0, 0.0).otherwise(0.5).alias("confidence"))
    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("review_id"), F.col("l_suppkey").alias("member_id")).agg(F.max("l_quantity").cast("long").alias("score"))
    return store.queued(rows, found.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("member_id"), F.col("s_name").alias("name")), "member_id"), "review_id")


@query("""WITH s AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 5 = 0) SELECT doc_id AS shot_id, s.h AS sha256, b.h IS NOT NULL OR row_number() OVER (PARTITION BY s.h ORDER BY doc_id) > 1 AS existed FROM s LEFT JOIN b ON s.h = b.h""")
def s_shot_observations(spark, d):
    """Four fifths of the documents arrive where a fifth is stored."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("shot_id"), F.sha2("text", 256).alias("sha256"))
    return store.observations(docs.where("shot_id % 5 <> 0"), docs.where("shot_id % 5 = 0"))


@query("""SELECT l_suppkey AS member_id, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1""")
def m_exc_complete_only(spark, d):
    captures = table(spark, d, "orders").select(F.col("o_orderkey").alias("capture_id"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("partial").alias("status"))
    facts = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "capture_id")
    return store.whole_captures(facts, captures).groupBy(F.col("l_suppkey").alias("member_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count("*").alias("n"))
