"""Evaluation against known truth, over suppliers as members, customers as reads and embeddings as frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import names
from sightline.operators import evaluate, metrics, nearest, pixels, resolve
from sightline.plans.base import query, weighted_sql
from sightline.sources.tables import table

#: Likeness of two columns by plain edits, as names.edit_ratio has it.
RATIO = "CAST(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 100 ELSE floor(100 * (greatest(length({a}), length({b})) - levenshtein({a}, {b})) / greatest(length({a}), length({b}))) END AS INTEGER)"


def _reads(spark, d):
    """Reads of each supplier's name in three modes: right, with a wrong digit, and empty or with junk before it."""
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name", "s_acctbal")
    digit = F.concat(F.expr("substring(s_name, 1, length(s_name) - 1)"), F.lit("x"))
    junk = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("| "), "s_name"))
    modes = F.array(*(F.struct(F.lit(k).alias("mode"), t.alias("text")) for k, t in enumerate((digit, F.col("s_name"), junk))))
    conf = F.round((F.col("s_suppkey") * 7 + F.col("m.mode") * 31) % 100 / 100.0, 2)
    return s.withColumn("m", F.explode(modes)).where((F.col("s_suppkey") % 4 != 0) | (F.col("m.mode") != 1)).select("s_nationkey", F.col("s_suppkey").alias("row"), "m.mode", "m.text", conf.alias("confidence"))


READS = "m AS (SELECT s_nationkey AS s_nationkey, s_suppkey AS row, mode, CASE mode WHEN 0 THEN s_name[1:length(s_name) - 1] || 'x' WHEN 1 THEN s_name ELSE CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '| ' || s_name END END AS text, round((s_suppkey * 7 + mode * 31) % 100 / 100.0, 2) AS confidence FROM supplier, (VALUES (0), (1), (2)) t(mode) WHERE s_suppkey % 4 <> 0 OR mode <> 1)"
PAIRS = f"p AS (SELECT m.s_nationkey, row, mode, text, confidence, s_suppkey AS member_id, CASE WHEN text = '' THEN 0 ELSE {RATIO.format(a='text', b='s_name')} END AS score FROM m JOIN supplier s ON m.s_nationkey = s.s_nationkey AND m.row % 8 = s_suppkey % 8)"


def _members(spark, d):
    """Members of a nation and number modulo 8: the closed set of a group."""
    return table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("member_id"), "s_name", (F.col("s_suppkey") % 8).alias("g"))


def _dealt(spark, d):
    """Reads with their group."""
    return _reads(spark, d).withColumn("g", F.col("row") % 8)


GROUP = ["s_nationkey", "g"]


def _best(spark, d, least=0):
    """(row, mode, text, member_id, score) of the best member of each read that isn't empty, if its score is `least` or more."""
    reads, members = _dealt(spark, d), _members(spark, d)
    some = reads.where("text <> ''")
    tops = nearest.nearest(some, members, GROUP, "text", "s_name", least=least).join(members, [*GROUP, "s_name"])
    tops = tops.groupBy(*GROUP, "text").agg(F.min("member_id").alias("member_id"), F.max("score").alias("score"))
    return some.join(tops, [*GROUP, "text"]).select("row", "mode", "text", "member_id", "score")


@query(f"""WITH {READS}, {PAIRS} SELECT row, member_id, max(score) AS score FROM p GROUP BY ALL""")
def a_uni_united_scores(spark, d):
    return evaluate.united_scores(_dealt(spark, d), _members(spark, d), GROUP, "row", "text", "member_id", "s_name")


@query(f"""WITH {READS}, {PAIRS}, t AS (SELECT row, mode, text, max(score) AS top FROM p WHERE text <> '' GROUP BY ALL) SELECT row, arg_max(text, (top, -mode)) AS text, max(top) AS top FROM t GROUP BY row""")
def a_uni_best_texts(spark, d):
    return evaluate.best_texts(_best(spark, d), ["row"], "mode")


@query(f"""WITH {READS}, v AS (SELECT row, mode, CASE WHEN text = '' THEN 'empty' WHEN e.s_name IS NOT NULL THEN CASE WHEN confidence >= 0.4 THEN 'exact' ELSE 'exact, weak' END WHEN j.s_name IS NOT NULL THEN 'junk-prefixed' ELSE 'unmatched' END AS verdict FROM m LEFT JOIN supplier e ON text = e.s_name LEFT JOIN supplier j ON substr(text, 3) = j.s_name AND text LIKE '| %') SELECT verdict, count(*) AS n FROM v GROUP BY 1""")
def a_rsc_read_verdicts(spark, d):
    truths = table(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return evaluate.read_verdicts(_reads(spark, d), truths, 0.4).groupBy("verdict").agg(F.count("*").alias("n"))


MEMBER = f"{PAIRS}, b AS (SELECT member_id, arg_max(struct_pack(text := text, score := score, confidence := confidence), (score, confidence, text)) AS r FROM p GROUP BY 1)"


@query(f"""WITH {READS}, {MEMBER} SELECT member_id, r.text AS text, r.score AS score, CASE WHEN r.score < 92 THEN 'missed' WHEN r.confidence < 0.4 THEN 'low confidence' ELSE 'creatable' END AS verdict FROM b""")
def a_mem_creatable_members(spark, d):
    reads, members = _dealt(spark, d), _members(spark, d)
    tops = nearest.nearest(members, reads, GROUP, "s_name", "text").join(members, [*GROUP, "s_name"])
    return evaluate.creatable(tops.join(reads, [*GROUP, "text"]), ["member_id"], 0.4).select("member_id", "text", "score", "verdict")


@query(f"""WITH {READS}, {PAIRS}, t AS (SELECT row, mode, max(score) AS top FROM p GROUP BY ALL), w AS (SELECT row, mode, arg_max(member_id, (score, -member_id)) AS won FROM p GROUP BY ALL) SELECT mode, count(*) FILTER (top >= 92) AS sure, (SELECT count(*) FROM m WHERE text = '' AND m.mode = t.mode) AS empty, count(DISTINCT won) FILTER (top >= 92) AS members FROM t JOIN w USING (row, mode) GROUP BY mode""")
def a_nam_name_probe(spark, d):
    """Bands read surely, reads that are empty, and distinct members that the best reads reach, by mode."""
    best = _best(spark, d, 92).groupBy("row", "mode").agg(F.max_by("member_id", F.struct("score", -F.col("member_id"))).alias("won"))
    rows = _reads(spark, d).groupBy("row", "mode").agg(F.bool_or(F.col("text") == "").alias("empty")).join(best, ["row", "mode"], "left")
    return rows.groupBy("mode").agg(F.count("won").alias("sure"), F.count_if("empty").alias("empty"), F.count_distinct("won").alias("members"))


AGREE = f"{PAIRS}, w AS (SELECT row, mode, arg_max(member_id, (score, -member_id)) AS won, max(score) AS top FROM p GROUP BY ALL), v AS (SELECT coalesce(a.row, b.row) AS row, coalesce(a.top >= 92, false) AS sa, coalesce(b.top >= 92, false) AS sb, a.won AS wa, b.won AS wb FROM (SELECT * FROM w WHERE mode = 0) a FULL JOIN (SELECT * FROM w WHERE mode = 1) b ON a.row = b.row)"


@query(f"""WITH {READS}, {AGREE} SELECT row, CASE WHEN sa AND sb THEN CASE WHEN wa = wb THEN 'agree' ELSE 'disagree' END WHEN sa THEN 'first only' WHEN sb THEN 'recovered' ELSE 'both weak' END AS verdict FROM v""")
def a_agr_agreement(spark, d):
    sure = _best(spark, d, 92).groupBy("row", "mode").agg(F.max_by("member_id", F.struct("score", -F.col("member_id"))).alias("member_id"), F.max("score").alias("score"))
    best = _reads(spark, d).select("row", "mode").distinct().join(sure, ["row", "mode"], "left")
    return evaluate.agreement(best.where("mode = 0"), best.where("mode = 1"), "row")


@query("""WITH w AS (SELECT o_custkey AS k, max(o_totalprice) AS want FROM orders GROUP BY 1), f AS (SELECT o_custkey AS k, max(o_totalprice * (1 + o_orderkey % 5 / 200.0)) AS got FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT w.k, CASE WHEN got IS NULL THEN 'missing' WHEN abs(got - want) / want <= 0.01 THEN 'ok' ELSE 'off' END AS verdict FROM w LEFT JOIN f ON w.k = f.k""")
def j_gate_expected_rows(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    want = o.groupBy("k").agg(F.max("o_totalprice").alias("want"))
    got = o.where("o_orderstatus <> 'P'").groupBy("k").agg(F.max(F.col("o_totalprice") * (1 + F.col("o_orderkey") % 5 / 200.0)).alias("value"))
    return evaluate.gate(want, got, ["k"]).select("k", "verdict")


COVER = f"""v AS (SELECT s_suppkey AS truth_id, s_nationkey AS truth_group, lpad(CAST(s_suppkey * 7919 % 99991 AS VARCHAR), 5, '0') AS code FROM supplier),
o1 AS (SELECT l_orderkey AS created_id, min(l_suppkey) AS k, min(l_partkey) % 25 AS grp FROM lineitem GROUP BY 1),
c AS (SELECT created_id, grp, CASE created_id % 3 WHEN 2 THEN 'nobody' WHEN 1 THEN translate(code, '01', 'Oi') ELSE code END AS name FROM o1 JOIN v ON k = truth_id),
p AS (SELECT n.name, v.*, {weighted_sql("lower(n.name)", "v.code")} AS score FROM (SELECT DISTINCT name FROM c) n, v),
b AS (SELECT name, arg_max(truth_id, (score, -truth_id)) AS truth_id, max(score) AS score, arg_max(truth_group, (score, -truth_id)) AS truth_group FROM p WHERE score >= 75 GROUP BY 1)"""


@query(f"""WITH {COVER}, o AS (SELECT c.*, truth_id, score, truth_group, arg_min(created_id, (-score, created_id)) FILTER (score >= 92) OVER (PARTITION BY truth_id) AS owner FROM c LEFT JOIN b ON c.name = b.name) SELECT created_id, truth_id, score, CASE WHEN NOT coalesce(score >= 92, false) THEN 'orphan' WHEN created_id <> owner THEN 'split' WHEN grp <> truth_group THEN 'wrong group' ELSE 'covered' END AS verdict FROM o""")
def j_cov_coverage(spark, d):
    """Created members against the true one most like them of all groups: covered, of another group, without one, or one of several for the same. An order creates a member with the code of its first supplier, sometimes with look-alikes or a name that is nobody's."""
    code = F.lpad((F.col("s_suppkey") * 7919 % 99991).cast("string"), 5, "0")
    truths = table(spark, d, "supplier").select(F.col("s_suppkey").alias("truth_id"), code.alias("code"), F.col("s_nationkey").alias("truth_group"))
    orders = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("created_id")).agg(F.min("l_suppkey").alias("truth_id"), (F.min("l_partkey") % 25).alias("group"))
    kind = F.col("created_id") % 3
    name = F.when(kind == 2, "nobody").when(kind == 1, F.translate("code", "01", "Oi")).otherwise(F.col("code"))
    created = orders.join(truths.select("truth_id", "code"), "truth_id").select("created_id", "group", name.alias("name"))
    best = evaluate.nearest_truth(created.select("name"), truths, "name", "code")
    return evaluate.coverage(created.select("created_id", "group"), created.select("created_id", "name").join(best, "name").drop("name"))


@query("""WITH g AS (SELECT o_custkey AS capture_id, o_orderstatus AS grp, count(*) AS parsed, count(*) FILTER (o_orderpriority < '4') AS matched_or_created, count(DISTINCT o_orderpriority) FILTER (o_orderpriority < '4') AS members, arg_min(o_orderkey % 9 + 1, o_orderkey) FILTER (o_orderkey % 4 <> 0) AS expected FROM orders GROUP BY ALL) SELECT *, expected IS NOT NULL AND members < expected AS can_create FROM g""")
def a_grp_group_tallies(spark, d):
    """A-GRP, A-DIST and ER-CREATE: tallies of a group against the first total that its header shows, and whether it has room for a member."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("capture_id"), F.col("o_orderstatus").alias("grp"), "o_orderkey", F.when(F.col("o_orderpriority") < "4", F.col("o_orderpriority")).alias("member"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 9 + 1).alias("total"))
    return resolve.group_tallies(o, ["capture_id", "grp"], "o_orderkey", "member", "total")


@query("""SELECT o_custkey AS capture_id, count(*) FILTER (o_orderstatus = 'F') AS matched, count(*) FILTER (o_orderstatus = 'O') AS queued, count(*) FILTER (o_orderstatus = 'P') AS duplicates FROM orders GROUP BY 1""")
def a_res_result_counters(spark, d):
    outcome = F.when(F.col("o_orderstatus") == "F", "fact").when(F.col("o_orderstatus") == "O", "review").otherwise("duplicate")
    return resolve.result_counters(table(spark, d, "orders").select(F.col("o_custkey").alias("capture_id"), outcome.alias("outcome")), "capture_id")


@query("""SELECT l_returnflag AS reason, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1""")
def a_rsn_reviews_by_reason(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_returnflag").alias("reason")).agg(F.count("*").alias("n"))


ANCHORS = "a AS (SELECT min(vec_id) AS anchor, label AS screen, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label)"


@query(f"""WITH {ANCHORS} SELECT e.vec_id AS frame, a.anchor, a.screen, round(greatest(0, list_cosine_similarity(e.embedding::DOUBLE[], a.v::DOUBLE[])), 4)::DOUBLE AS score FROM embeddings e, a""")
def j_eval_frames_by_anchors(spark, d):
    """Frames are vectors, the first of each screen its anchor: every frame is scored by each, as in matching templates."""
    return _scored(spark, d).select("frame", "anchor", "screen", F.round("score", 4).alias("score"))


def _scored(spark, d):
    e = table(spark, d, "embeddings")
    frames = e.select(F.col("vec_id").alias("frame"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    first = e.groupBy("label").agg(F.min("vec_id").alias("anchor"), F.min_by("embedding", "vec_id").alias("v"))
    anchors = first.select("anchor", F.col("label").alias("screen"), F.transform("v", lambda x: x.cast("double")).alias("y"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return frames.crossJoin(F.broadcast(anchors)).withColumn("score", F.greatest(F.lit(0.0), dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))))  # one anchor a screen


@query(f"""WITH {ANCHORS}, s AS (SELECT e.label, a.anchor, a.screen, round(greatest(0, list_cosine_similarity(e.embedding::DOUBLE[], a.v::DOUBLE[])), 4) AS score FROM embeddings e, a WHERE e.label = a.screen) SELECT anchor, count(*) AS frames, count(*) FILTER (score >= 0.3) AS found, round(min(score), 4)::DOUBLE AS weakest FROM s GROUP BY 1""")
def j_eva2_anchors_on_their_screen(spark, d):
    """Action anchors are looked for on frames of their own screen only."""
    s = _scored(spark, d).where("label = screen").withColumn("score", F.round("score", 4))
    return s.groupBy("anchor").agg(F.count("*").alias("frames"), F.count_if(F.col("score") >= 0.3).alias("found"), F.min("score").alias("weakest"))


@query("""WITH r AS (SELECT o_custkey AS read, o_orderpriority AS rank, max(o_totalprice / 600000) AS score FROM orders GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY score DESC, rank) AS n FROM r) SELECT read, CASE WHEN max(score) FILTER (n = 1) - coalesce(max(score) FILTER (n = 2), 0) >= 0.2 THEN max(rank) FILTER (n = 1) END AS rank FROM k GROUP BY 1""")
def i_bdg_rank_badges(spark, d):
    """A badge is told if it beats the next by 0.20."""
    r = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("read"), F.col("o_orderpriority").alias("rank")).agg(F.max(F.col("o_totalprice") / 600000).alias("score"))
    return evaluate.clear_winner(r, "read", "rank", "score", 0.2)


PIXELS = "x AS (SELECT o_custkey % 50 AS frame, CAST(o_orderkey // 40 % 24 AS BIGINT) AS y, o_orderkey % 40 AS x, CAST(floor(o_totalprice) AS BIGINT) % 256 AS v FROM orders)"


def _pixels(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("frame"), (F.floor(F.col("o_orderkey") / 40) % 24).alias("y"), (F.col("o_orderkey") % 40).alias("x"), (F.floor("o_totalprice") % 256).alias("v"))


@query(f"""WITH {PIXELS} SELECT frame, y, round(avg(v), 6) AS mean FROM x GROUP BY ALL""")
def a_prof_row_profiles(spark, d):
    return pixels.row_profile(_pixels(spark, d)).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {PIXELS} SELECT frame, round(avg(v), 6) AS mean, round(var_pop(v) * count(v), 3) AS variance FROM x GROUP BY 1""")
def a_var_moments(spark, d):
    return pixels.moments(_pixels(spark, d)).select("frame", F.round("mean", 6).alias("mean"), F.round("variance", 3).alias("variance"))


@query(f"""WITH {PIXELS}, h AS (SELECT frame, v, count(*) AS n FROM x GROUP BY ALL), c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY frame ORDER BY v) AS BIGINT) AS cdf FROM h), b AS (SELECT *, min(cdf) OVER (PARTITION BY frame) AS low, sum(n) OVER (PARTITION BY frame) AS size FROM c) SELECT frame, v, n, cdf, CASE WHEN size > low THEN CAST((cdf - low) * 255 // (size - low) AS BIGINT) ELSE v END AS mapped FROM b""")
def a_hist_equalising(spark, d):
    return pixels.equalising_table(_pixels(spark, d))


PHASES = f"{PIXELS}, r AS (SELECT frame, y, avg(v) AS mean FROM x GROUP BY ALL), m AS (SELECT frame, pitch, y % pitch AS phase, round(avg(mean), 9) AS mean, avg(mean) AS exact, count(*) AS rows FROM r, (VALUES (6), (7), (8), (9), (10), (11), (12)) t(pitch) GROUP BY ALL), b AS (SELECT frame, CAST(pitch AS INTEGER) AS pitch, arg_max(struct_pack(phase := phase, rows := rows), (mean, -phase)) AS r, round(max(exact) - min(exact), 6) AS contrast FROM m GROUP BY ALL)"


@query(f"""WITH {PHASES} SELECT frame, pitch, r.phase AS phase, contrast, r.rows AS rows FROM b""")
def i_phs_phases(spark, d):
    return pixels.phases(pixels.row_profile(_pixels(spark, d)), spark.range(6, 13).select(F.col("id").cast("int").alias("pitch")))


@query(f"""WITH {PHASES} SELECT frame, arg_max(pitch, (round(contrast * sqrt(r.rows), 6), -pitch)) AS pitch, arg_max(contrast, (round(contrast * sqrt(r.rows), 6), -pitch)) AS contrast FROM b WHERE r.rows > 1 GROUP BY 1""")
def i_pit_fitting_pitch(spark, d):
    return pixels.fitting_pitch(pixels.phases(pixels.row_profile(_pixels(spark, d)), spark.range(6, 13).select(F.col("id").cast("int").alias("pitch"))))


@query("""SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'click')) AS assigned, round(coalesce(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type IN ('purchase', 'click')), 0), 0), 6) AS honoured FROM events GROUP BY 1""")
def m_trn_slots_honoured(spark, d):
    ev = table(spark, d, "events")
    return metrics.ratio(ev, "user_id", F.col("event_type").isin("purchase", "click"), F.col("event_type") == "purchase", "assigned", "honoured")


@query("""WITH o AS (SELECT user_id, count(*) FILTER (event_type IN ('view', 'click') AND value >= 40) AS available, count(*) FILTER (event_type = 'click' AND value >= 40) AS joined FROM events GROUP BY 1) SELECT user_id, available, round(coalesce(joined / nullif(available, 0), 0), 6) AS joined FROM o""")
def m_ral_rallies_joined(spark, d):
    """Rallies that were on while the member was online: views and clicks from a value of 40 on."""
    ev = table(spark, d, "events")
    online = F.col("value") >= 40
    return metrics.ratio(ev, "user_id", F.col("event_type").isin("view", "click") & online, F.col("event_type").isin("click") & online, "available", "joined")


@query("""SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days FROM events WHERE event_type = 'purchase' AND value > 0 GROUP BY 1""")
def m_don_donation_days(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase' and value > 0").groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("days"))


@query("""WITH l AS (SELECT user_id, date_diff('day', CAST(max(ts) AS DATE), (SELECT CAST(max(ts) AS DATE) FROM events)) AS age FROM events GROUP BY 1) SELECT user_id, CAST(age AS INTEGER) AS age, round(exp(-age / 7.0), 6) AS weight FROM l""")
def m_stk_last_seen_decay(spark, d):
    """Weight of the last sighting, decaying with a time of seven days."""
    ev = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))
    end = ev.agg(F.max("day").alias("end"))
    last = ev.groupBy("user_id").agg(F.max("day").alias("day")).join(F.broadcast(end))
    return last.select("user_id", F.datediff("end", "day").alias("age"), F.round(metrics.decay(F.datediff("end", "day")), 6).alias("weight"))

