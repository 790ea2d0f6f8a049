"""Entity resolution end to end, and its probes, over suppliers as the members of their nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import names, parse
from sightline.operators import ingest, likely, nearest, probes, resolve
from sightline.plans.base import query, weighted_sql
from sightline.plans.scores import RATIO
from sightline.sources.tables import table


def _members(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("capture_id"), F.col("s_suppkey").alias("member_id"), F.col("s_name").alias("name"), F.lpad((F.col("s_suppkey") * 7919 % 99991).cast("string"), 5, "0").alias("code"))


ROWS = "k AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_linenumber % 4 AS phase, CAST(l_quantity * 2 AS INTEGER) AS top, CAST(floor(l_extendedprice) AS BIGINT) + 100000 AS v, round(1 - l_discount * 4, 2) AS conf, CAST(90 + l_quantity % 11 AS INTEGER) AS score, l_partkey % 5 AS kind, l_suppkey % 6 = 0 AS shifted, l_partkey % 7 = 0 AS retried FROM lineitem)"


@query(f"""WITH {ROWS}, b AS (SELECT *, CASE WHEN shifted THEN v + 50 ELSE v - 40 END AS lo, CASE WHEN shifted THEN v + 90 ELSE v + 40 END AS hi FROM k),
c AS (SELECT *, CASE WHEN kind IN (0, 1) THEN v WHEN kind = 2 AND NOT shifted THEN v END AS read FROM b),
e AS (SELECT *, CASE WHEN read IS NULL AND kind <> 4 AND NOT retried AND NOT shifted THEN v END AS late FROM c),
f AS (SELECT *, coalesce(read, late) AS val, kind = 2 AND read IS NOT NULL AS fixed, least(CASE WHEN phase = 2 THEN 0.85 ELSE score / 100.0 END, CASE WHEN late IS NOT NULL THEN 0.9 ELSE conf END) AS weak FROM e),
g AS (SELECT *, CASE WHEN weak < 0.8 AND NOT fixed AND lo > 0 AND hi - lo <= val THEN 0.8 ELSE weak END AS conf2 FROM f),
r AS (SELECT *, CASE WHEN phase = 0 THEN CASE WHEN top >= 75 THEN 'ambiguous_name_match' ELSE 'no_confident_match' END WHEN val IS NULL THEN 'unparseable_points' WHEN NOT val BETWEEN lo AND hi THEN 'points_out_of_order' WHEN conf2 < 0.8 THEN 'low_confidence_points' END AS why FROM g)
SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN phase = 3 THEN 'duplicate' WHEN why IS NOT NULL THEN 'review' ELSE 'fact' END AS outcome, CASE WHEN phase <> 3 AND why IS NULL THEN val END AS value, CASE WHEN phase <> 3 AND (why IS NULL OR why = 'low_confidence_points') THEN round(conf2, 6) END::DOUBLE AS confidence, CASE WHEN phase <> 3 THEN why END AS reason FROM r""")
def er_att_attribution(spark, d):
    """ER-ATT and ER-LTY: plain reads, reads with a trailing artifact, damaged digits with one, and reads that only a late retry can mend, in windows that hold or don't."""
    k = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_linenumber") % 4).alias("phase"), (F.col("l_quantity") * 2).cast("int").alias("top"), (F.floor("l_extendedprice") + 100_000).alias("v"), F.round(1 - F.col("l_discount") * 4, 2).alias("conf"), (90 + F.col("l_quantity") % 11).cast("int").alias("score"), (F.col("l_partkey") % 5).alias("kind"), (F.col("l_suppkey") % 6 == 0).alias("shifted"), (F.col("l_partkey") % 7 == 0).alias("retried"))
    shown, v = F.format_string("%,d", "v"), F.col("v")
    broken = F.concat(F.expr("substring(s, 1, length(s) - 3)"), F.lit("?"), F.expr("substring(s, -2, 2)"), F.lit(" pts"))
    k = k.withColumn("s", shown)
    text = F.when(F.col("kind") == 0, F.col("s")).when(F.col("kind") == 1, F.concat("s", F.lit(" pts|"))).when(F.col("kind") == 2, broken).otherwise("no number")
    retry = F.when(F.col("kind") == 4, "still none").otherwise(F.concat("s", F.lit(" .")))
    lo, hi = v + F.when(F.col("shifted"), 50).otherwise(-40), v + F.when(F.col("shifted"), 90).otherwise(40)
    told = resolve.attributed(k, "a", F.col("phase"), F.col("top"), text, F.col("conf"), F.col("score"), lo, hi, retry, F.lit(0.9), F.col("retried"))
    return told.select("l_orderkey", "l_linenumber", "l_suppkey", "a.*")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, metric, CASE WHEN v IS NULL THEN 'unparseable_' || metric WHEN least(1 - l_tax, c) < 0.95 THEN 'low_confidence_' || metric ELSE 'fact' END AS outcome FROM (SELECT *, 'power' AS metric, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS v, 1 - l_discount AS c FROM lineitem UNION ALL SELECT *, 'level', CASE WHEN l_linenumber <> 3 THEN l_linenumber END, 0.97 FROM lineitem)""")
def er_fact_field_outcomes(spark, d):
    """Two fields of each row, at a write gate that the data straddle; the operator's own gate is 0.80."""
    li = table(spark, d, "lineitem").withColumn("match", 1 - F.col("l_tax") - 0.15).withColumn("power", F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))).withColumn("level", F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")))
    li = li.withColumn("power_conf", 0.85 - F.col("l_discount")).withColumn("level_conf", F.lit(0.82)).withColumn("match", F.round("match", 6)).withColumn("power_conf", F.round("power_conf", 6))
    return resolve.field_outcomes(li, ["l_orderkey", "l_linenumber", "l_suppkey"], "match", {"power": ("power", "power", "power_conf"), "level": ("level", "level", "level_conf")}).select("l_orderkey", "l_linenumber", "l_suppkey", "metric", "outcome")


@query("""SELECT l_orderkey, l_suppkey % 3 AS row, arg_min(l_returnflag, (l_linenumber, l_suppkey, l_returnflag)) AS reason FROM lineitem GROUP BY ALL""")
def er_rvw_one_review_per_row(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("row"), F.struct("l_linenumber", "l_suppkey", "l_returnflag").alias("o"), F.col("l_returnflag").alias("reason"))
    return resolve.once_per_row(li, ["l_orderkey", "row"], "o").select("l_orderkey", "row", "reason")


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS text, 0.9 AS conf FROM orders) SELECT o_orderkey, CASE WHEN text = '' THEN o_orderkey || ' x' ELSE text END AS text, text = '' AS retried, text <> '' AND o_orderkey % 3 <> 0 AS seeds FROM t""")
def er_seed_seeds(spark, d):
    """ER-RTY and ER-SEED: empty reads are read again; those, rows without a member and weak ones don't seed."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("t"), F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(5).alias("member"))
    read = resolve.with_retry(F.col("t"), F.lit(0.9), F.concat(F.col("o_orderkey").cast("string"), F.lit(" x")), F.lit(0.99))
    rows = o.withColumn("r", read).select("o_orderkey", "member", "r.*")
    plain = rows.withColumn("text", F.when(F.col("retried"), F.col("text")).otherwise(F.format_string("%,d", F.col("text").cast("int"))))
    return resolve.seeds(plain).select("o_orderkey", F.replace("text", F.lit(","), F.lit("")).alias("text"), "retried", "seeds")


CODES = "c AS (SELECT s_nationkey AS capture_id, s_suppkey AS member_id, lpad(CAST(s_suppkey * 7919 % 99991 AS VARCHAR), 5, '0') AS code FROM supplier)"


@query(f"""WITH {CODES}, p AS (SELECT a.capture_id, a.member_id AS a, b.member_id AS b, {RATIO.format(a='a.code', b='b.code')} AS score FROM c a JOIN c b ON a.capture_id = b.capture_id AND a.member_id < b.member_id) SELECT capture_id, arg_max(struct_pack(a := a, b := b), (score, -a, -b)).a AS a, arg_max(struct_pack(a := a, b := b), (score, -a, -b)).b AS b, max(score) AS score FROM p GROUP BY 1""")
def er_clo_closest_pair(spark, d):
    """ER-CLO and J-CLO: the two codes of a nation most alike."""
    return nearest.closest(_members(spark, d), ["capture_id"], "code", "member_id")


@query(f"""WITH {CODES}, p AS (SELECT a.capture_id, a.member_id AS a, b.member_id AS b, {weighted_sql("a.code", "b.code")} AS score FROM c a JOIN c b ON a.capture_id = b.capture_id AND a.member_id < b.member_id) SELECT capture_id, arg_max(struct_pack(a := a, b := b), (score, -a, -b)).a AS a, arg_max(struct_pack(a := a, b := b), (score, -a, -b)).b AS b, max(score) AS score FROM p GROUP BY 1""")
def j_clo_closest_names(spark, d):
    """J-CLO by the weighted likeness and a falling bound, without all pairs."""
    return likely.closest_names(_members(spark, d), ["capture_id"], "code", "member_id")


@query("""SELECT s_suppkey, '9' || s_name[2:] AS decoy FROM supplier""")
def er_dec_decoys(spark, d):
    """Of 'Supplier' the first letter has a look-alike, which takes its place."""
    return table(spark, d, "supplier").select("s_suppkey", probes.decoy(F.col("s_name")).alias("decoy"))


@query("""SELECT s_suppkey, coalesce(lead(s_name) OVER w, first_value(s_name) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) AS label FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)""")
def er_shf_rotated_truth(spark, d):
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.col("s_name").alias("label"))
    return probes.rotated(s, ["s_nationkey"], "s_suppkey", "label").select("s_suppkey", "label")


@query()
def er_scn_parameter_grid(spark, d):
    """Floors and margins of the assignment, scored; every third code is read with a wrong digit."""
    m = _members(spark, d)
    reads = m.select("capture_id", F.col("member_id").cast("int").alias("row"), F.when(F.col("member_id") % 3 == 0, F.concat(F.expr("substring(code, 1, 4)"), F.lit("x"))).otherwise(F.col("code")).alias("text"))
    members = m.select("capture_id", F.col("member_id").cast("int").alias("member"), "code")
    truth = m.select("capture_id", F.col("member_id").cast("int").alias("row"), F.col("member_id").cast("int").alias("member"))
    return probes.grid_of_names(reads, members, truth, "capture_id", "text", "code", names.edit_ratio, nearest.as_written, [40, 50, 60, 70, 80, 90, 92], [1, 5, 10, 20, 30])


def _numbers(spark, d):
    """Readings of totals in two configurations: right, off by half a percent, wrong, with a letter in it or empty."""
    o = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("want"), F.explode(F.array(F.lit(0), F.lit(1))).alias("config"))
    kind = (F.col("o_orderkey") + F.col("config") * 2) % 5
    n = F.when(kind == 1, F.floor(F.col("want") * 1.005)).when(kind == 2, F.col("want") * 3).otherwise(F.col("want"))
    text = F.when(kind == 4, "").when(kind == 3, F.concat(F.lit("x"), F.format_string("%,d", n))).otherwise(F.format_string("%,d", n))
    return o.withColumn("text", text).withColumn("points", parse.points("text")).withColumn("confidence", F.round(F.col("o_orderkey") % 10 / 10, 1)).withColumn("retried", F.col("o_orderkey") % 6 == 0)


NUMBERS = "n AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS want, config, (o_orderkey + config * 2) % 5 AS kind, round(o_orderkey % 10 / 10, 1) AS confidence, o_orderkey % 6 = 0 AS retried FROM orders, (VALUES (0), (1)) t(config)), p AS (SELECT *, CASE kind WHEN 1 THEN CAST(floor(want * 1.005) AS BIGINT) WHEN 2 THEN want * 3 WHEN 0 THEN want END AS points FROM n)"


@query(f"""WITH {NUMBERS} SELECT config, count(*) FILTER (kind = 4) AS empty, count(*) FILTER (kind = 3) AS unparseable, count(*) FILTER (points = want) AS exact, count(*) FILTER (points <> want AND abs(points - want) / want <= 0.01) AS "close", count(*) FILTER (abs(points - want) / want > 0.01) AS off, count(*) FILTER (confidence < 0.4 AND kind <> 4) AS weak, count(*) FILTER (retried) AS retried FROM p GROUP BY 1""")
def er_ppr_points_probe(spark, d):
    """ER-PPR, and ER-SWP: one row for each configuration of a sweep."""
    return probes.points_probe(_numbers(spark, d), ["config"], 0.4)


@query(f"""WITH {NUMBERS} SELECT o_orderkey, CAST(min(CASE WHEN points = want THEN 0 WHEN abs(points - want) / want <= 0.01 THEN 1 WHEN points IS NOT NULL THEN 2 ELSE 3 END) AS INTEGER) AS tier FROM p GROUP BY 1""")
def er_ppr_best_points(spark, d):
    return probes.best_points(_numbers(spark, d), ["o_orderkey"]).select("o_orderkey", "tier")


@query("""WITH r AS (SELECT l_orderkey AS truth, l_linenumber AS seq, l_suppkey AS y, l_returnflag AS normal, round(1 - l_discount * 8, 2) AS confidence, CAST(80 + l_quantity % 20 AS INTEGER) AS score FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY truth, normal ORDER BY seq, y, score, normal, confidence) AS k FROM r), f AS (SELECT truth, arg_min(struct_pack(normal := normal, score := score), (seq, y, score, normal, confidence)) AS f FROM k WHERE confidence >= 0.6 OR k >= 3 GROUP BY 1) SELECT t.truth, f.f.normal AS claimed, CASE WHEN f.f IS NULL THEN 'never created' WHEN f.f.score >= 92 THEN 'covered' ELSE 'orphaned' END AS verdict FROM (SELECT DISTINCT truth FROM r) t LEFT JOIN f ON t.truth = f.truth""")
def er_fws_first_wins(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("truth"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("y"), F.col("l_returnflag").alias("normal"), F.round(1 - F.col("l_discount") * 8, 2).alias("confidence"), (80 + F.col("l_quantity") % 20).cast("int").alias("score"))
    return probes.first_wins(r, ["truth"], ["seq", "y", "score", "normal", "confidence"], 0.6, 3)


def ranking_inputs(spark, d):
    """A nation is a capture, its suppliers the members, ranked by their number; every seventh row is nobody's, every fifth member has no row, every eleventh row comes twice."""
    m = _members(spark, d)
    there = m.where("member_id % 5 <> 0").withColumn("row", F.col("member_id"))
    again = there.where("member_id % 11 = 0").withColumn("row", F.col("member_id") + 1_000_000)
    lost = m.where("member_id % 7 = 0 and capture_id % 2 = 0").withColumn("row", F.col("member_id") + 2_000_000).withColumn("code", F.lit("~~~"))
    rows = there.union(again).union(lost)
    reads = rows.select("capture_id", "row", F.explode(F.array(F.struct(F.lit(0).alias("mode"), F.col("code").alias("text")), F.struct(F.lit(1).alias("mode"), F.concat(F.expr("substring(code, 1, 4)"), F.lit("?")).alias("text")))).alias("m")).select("capture_id", "row", "m.*")
    value = 90_000_000 - F.col("row") * 13
    shown = F.format_string("%,d", value)
    text = F.when(F.col("row") % 13 == 0, "").when(F.col("row") % 17 == 0, F.concat(shown, F.lit(" pts"))).when(F.col("row") % 19 == 0, "no number").otherwise(shown)
    points = rows.select("capture_id", "row", text.alias("text"), F.round(0.7 + F.col("row") % 4 / 10, 2).alias("confidence"), shown.alias("retry_text"), F.lit(0.95).alias("retry_confidence"), shown.alias("late_text"), F.lit(0.9).alias("late_confidence"))
    captures = table(spark, d, "nation").select(F.col("n_nationkey").alias("capture_id"), F.when(F.col("n_nationkey") % 5 == 4, "partial").otherwise("complete").alias("status"))
    return captures, m.select("capture_id", "member_id", F.col("code").alias("name")), reads, points


@query()
def er_vs_ranking(spark, d):
    """The whole ranking pipeline: what became of each row."""
    return ingest.ranking(*ranking_inputs(spark, d), score=names.edit_ratio, forms=nearest.as_written)["rows"]


@query()
def er_vs_results(spark, d):
    return ingest.ranking(*ranking_inputs(spark, d), score=names.edit_ratio, forms=nearest.as_written)["results"]


def roster_inputs(spark, d):
    """Groups of a nation by the last digit of a supplier; members are the even ones, so the odd ones are created while the header's total lasts."""
    m = _members(spark, d).withColumn("group", (F.col("member_id") % 3).cast("int"))
    rows = m.select("capture_id", "group", F.col("member_id").alias("ordinal"), F.when(F.col("member_id") % 23 == 0, "  ").otherwise(F.col("code")).alias("name"), F.round(0.3 + F.col("member_id") % 7 / 10, 1).alias("confidence"))
    header = m.groupBy("capture_id", "group").agg(F.count("*").alias("n")).select("capture_id", "group", F.when(F.col("capture_id") % 4 != 3, F.col("n") - F.col("capture_id") % 2).alias("expected"))
    fields = m.select("capture_id", "group", F.col("member_id").alias("ordinal"), F.when(F.col("member_id") % 9 != 0, F.col("member_id") * 1e5).alias("power"), F.lit(30).alias("level"), F.lit(1.5).alias("hours"), F.lit(0.9).alias("power_conf"), F.when(F.col("member_id") % 4 == 0, 0.5).otherwise(0.95).alias("level_conf"), F.lit(0.99).alias("hours_conf"))
    stated = table(spark, d, "nation").select(F.col("n_nationkey").alias("capture_id"), F.lit(None).cast("long").alias("stated"))
    known = m.where("member_id % 2 = 0").select("capture_id", "group", "member_id", F.col("code").alias("name"))
    return known, rows.join(header, ["capture_id", "group"]), fields, stated


ROSTER_SQL = f"""WITH RECURSIVE m AS (SELECT s_nationkey AS capture_id, CAST(s_suppkey % 3 AS INTEGER) AS "group", s_suppkey AS member_id, lpad(CAST(s_suppkey * 7919 % 99991 AS VARCHAR), 5, '0') AS code FROM supplier),
r AS (SELECT capture_id, "group", member_id AS ordinal, CASE WHEN member_id % 23 = 0 THEN '' ELSE code END AS name, round(0.3 + member_id % 7 / 10.0, 1) AS conf, CASE WHEN capture_id % 4 <> 3 THEN count(*) OVER g - capture_id % 2 END AS total, row_number() OVER (g ORDER BY member_id) AS rn FROM m WINDOW g AS (PARTITION BY capture_id, "group")),
p AS (SELECT capture_id, "group", ordinal, member_id, CASE WHEN name = '' THEN 0 ELSE {weighted_sql("name", "code")} END AS score FROM r JOIN (SELECT * FROM m WHERE member_id % 2 = 0) USING (capture_id, "group")),
b AS (SELECT capture_id, "group", ordinal, max(score) AS known, arg_max(member_id, (score, -member_id)) AS best FROM p GROUP BY ALL), q AS (SELECT r.*, coalesce(known, 0) AS known, best FROM r LEFT JOIN b USING (capture_id, "group", ordinal)),
st AS (SELECT DISTINCT capture_id, "group", CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS pool, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS ordinal, CAST('' AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS member_id FROM r
UNION ALL SELECT capture_id, "group", n + 1, CASE WHEN o = 'created' THEN list_append(pool, name) ELSE pool END, CASE WHEN o = 'created' THEN list_append(used, -len(pool) - 1) WHEN o = 'matched' THEN list_distinct(list_append(used, who)) ELSE used END, ordinal, o, CASE o WHEN 'created' THEN -len(pool) - 1 WHEN 'matched' THEN who END
FROM (SELECT *, CASE WHEN name = '' THEN 'unreadable_name' WHEN top >= 92 THEN 'matched' WHEN top >= 75 THEN 'ambiguous_name_match' WHEN conf < 0.4 THEN 'low_confidence_name' WHEN total IS NULL THEN 'no_confident_match_group_count_unknown' WHEN len(used) >= total THEN 'no_confident_match_group_full' ELSE 'created' END AS o
FROM (SELECT *, greatest(known, coalesce(list_max(near), 0)) AS top, CASE WHEN known >= coalesce(list_max(near), 0) THEN best ELSE -list_position(near, list_max(near)) END AS who
FROM (SELECT st.capture_id, st."group", n, pool, used, q.ordinal, q.name, q.conf, q.total, q.known, q.best, CASE WHEN q.name = '' THEN [] ELSE list_transform(pool, lambda c: {weighted_sql("q.name", "c")}) END AS near FROM st JOIN q ON q.capture_id = st.capture_id AND q."group" = st."group" AND q.rn = n + 1))))
SELECT capture_id, "group", ordinal, outcome, member_id FROM st WHERE n > 0"""


@query(ROSTER_SQL)
def er_ros_decisions(spark, d):
    """The whole roster pipeline: who each row is."""
    return ingest.roster(*roster_inputs(spark, d))["decisions"]


@query()
def er_ros_reviews(spark, d):
    return ingest.roster(*roster_inputs(spark, d))["reviews"].groupBy("reason").agg(F.count("*").alias("n"))
