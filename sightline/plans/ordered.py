"""Ordered observations over events and lines: sightings, runs, windows, concatenations and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import sequences
from sightline.plans.base import query
from sightline.sources.tables import table


@query("""WITH RECURSIVE t AS (SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey AS s, l_quantity AS y, l_returnflag = 'R' AS good, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_returnflag = 'R') AS k FROM lineitem),
f AS (SELECT o, k, [y] AS ys, [good] AS done, 0 AS place, 'new' AS action FROM t WHERE k = 1 UNION ALL SELECT o, k, CASE WHEN p IS NULL THEN ys || [y] ELSE ys END, CASE WHEN p IS NULL THEN done || [good] ELSE list_transform(range(1, len(done) + 1), lambda i: CASE WHEN i = p THEN done[i] OR good ELSE done[i] END) END, CAST(coalesce(p - 1, len(ys)) AS INTEGER), CASE WHEN p IS NULL THEN 'new' WHEN done[p] THEN 'skipped' ELSE 'read again' END FROM (SELECT t.o, t.k, t.y, t.good, f.ys, f.done, list_filter(range(1, len(f.ys) + 1), lambda i: abs(f.ys[i] - t.y) <= 4)[1] AS p FROM f JOIN t ON t.o = f.o AND t.k = f.k + 1))
SELECT t.o AS l_orderkey, n AS l_linenumber, s AS l_suppkey, y AS l_quantity, good, place, action FROM t JOIN f ON t.o = f.o AND t.k = f.k""")
def w_seen_sightings(spark, d):
    """Sightings within 4 of a collected row are that row; it is read again until a returned line resolves it."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", (F.col("l_returnflag") == "R").alias("good"))
    return sequences.collected(li, ["l_orderkey"], ["l_linenumber", "l_suppkey", "l_quantity", "good"], "l_quantity", 4, "good")


@query("""SELECT o_custkey AS g, arg_min(CAST(floor(o_totalprice) AS BIGINT), o_orderkey) FILTER (o_orderstatus <> 'P') AS total FROM orders GROUP BY 1""")
def w_fst_first_total(spark, d):
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("g"), "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice")).alias("total"))
    return sequences.first_known(t, ["g"], ["o_orderkey"], "total")


CONFIRMED = "t AS (SELECT user_id AS u, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type IN ('error', 'view', 'click') AS c FROM events), i AS (SELECT u, min(e) AS first, max(e) AS last, min(n) AS lo, max(n) AS hi, count(*) AS len FROM (SELECT *, n - row_number() OVER (PARTITION BY u ORDER BY n) AS g FROM t WHERE c) GROUP BY u, g HAVING count(*) > 1), b AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY u ORDER BY len DESC, lo) = 1), s AS (SELECT i.*, CASE WHEN i.hi < b.lo THEN 'l' ELSE 'r' END AS side FROM i JOIN b USING (u) WHERE i.hi < b.lo OR i.lo > b.hi), r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY u, side ORDER BY len DESC, lo) = 1)"


@query(f"""WITH {CONFIRMED} SELECT u AS user_id, first, last, len - 1 AS bands FROM b UNION ALL SELECT u, first, last, len - 1 FROM r""")
def w_conf_confirmed_bands(spark, d):
    t = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").isin("error", "view", "click").alias("c"))
    return sequences.confirmed_bands(t, ["user_id"], "event_id", "c")


@query("""WITH t AS (SELECT l_orderkey AS o, l_linenumber AS pos, max(l_quantity) AS s FROM lineitem GROUP BY ALL), p AS (SELECT o, pos AS peak_at, s AS peak FROM t QUALIFY row_number() OVER (PARTITION BY o ORDER BY s DESC, pos) = 1), f AS (SELECT t.o, t.s, row_number() OVER (PARTITION BY t.o ORDER BY t.s DESC, t.pos) AS k FROM t JOIN p USING (o) WHERE abs(t.pos - p.peak_at) > 1 QUALIFY k <= 3), d AS (SELECT o, string_agg(CAST(CAST(s AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS decoys, max(s) FILTER (k = 1) AS best FROM f GROUP BY 1) SELECT p.o AS l_orderkey, peak_at, peak, coalesce(decoys, '') AS decoys, peak - best AS margin FROM p LEFT JOIN d ON p.o = d.o""")
def w_peak_decoys(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("at")).agg(F.max("l_quantity").alias("s"))
    got = sequences.peak_and_decoys(t, ["l_orderkey"], "at", "s", 1)
    return got.withColumn("decoys", F.array_join(F.transform("decoys", lambda x: x.cast("long").cast("string")), ","))


@query("""WITH b AS (SELECT l_orderkey AS o, CAST(l_quantity AS BIGINT) AS lo, CAST(l_quantity AS BIGINT) + l_linenumber AS hi FROM lineitem), g AS (SELECT o, greatest(coalesce(max(hi) OVER (PARTITION BY o ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2), 2) AS start, lo AS stop FROM b UNION ALL SELECT o, greatest(max(hi), 2), 55 FROM b GROUP BY o) SELECT o AS l_orderkey, start, stop FROM g WHERE stop > start AND stop - start >= 3""")
def u_gap_free_windows(spark, d):
    b = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("lo"), (F.col("l_quantity").cast("long") + F.col("l_linenumber")).alias("hi"))
    return sequences.free_windows(b, ["l_orderkey"], "lo", "hi", 2, 55, 3)


@query("""SELECT o_custkey AS capture_id, o_orderpriority AS grp, o_orderkey AS frame, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) - 1 AS seq FROM orders""")
def u_cat_renumbered(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("capture_id"), F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("frame"))
    return sequences.renumbered(o, ["capture_id"], "grp", "frame")


@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer""")
def o_stb_stable_order(spark, d):
    """Candidates by score, the first of equals staying first: the ordinal is the last key."""
    from pyspark.sql import Window

    return table(spark, d, "customer").select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).alias("place"))


@query("""SELECT coalesce(nullif(event_type, 'error'), '<none>') AS predicted, count(*) AS n FROM events GROUP BY 1 ORDER BY predicted = '<none>', predicted""")
def o_non_sentinel_last(spark, d):
    none = F.when(F.col("event_type") == "error", "<none>").otherwise(F.col("event_type"))
    return table(spark, d, "events").groupBy(none.alias("predicted")).agg(F.count("*").alias("n")).orderBy(F.col("predicted") == "<none>", "predicted")


@query("""SELECT l_orderkey, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',' ORDER BY l_quantity) AS bands FROM lineitem GROUP BY 1""")
def o_bnd_bands_in_order(spark, d):
    y = F.sort_array(F.collect_list(F.col("l_quantity").cast("long")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(y, lambda x: x.cast("string")), ",").alias("bands"))
