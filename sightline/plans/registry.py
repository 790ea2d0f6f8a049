"""Queries over the driver's tables, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.functions import names, parse
from sightline.operators import claims, evaluate, facts, graphs, likely, metrics, nearest, planner, resolve, sequences
from sightline.plans import evaluation, fields, frames, ordered, planning, published, scores, store, streams  # noqa: F401  each adds its queries
from sightline.plans.base import weighted_sql
from sightline.plans.base import QUERIES, SQL, query  # noqa: F401
from sightline.sources import blobs, recognised
from sightline.sources.tables import FACTS_SQL, RUNS_SQL, table
from sightline.sources.tables import facts as fact_rows
from sightline.sources.tables import runs as run_rows

UPSERT_SQL = f"""{FACTS_SQL}, up AS (SELECT member_id, metric, period_key, source, observed_at, value, confidence, min(arrival) OVER k AS fact_id, count(*) OVER k AS reads
FROM facts WINDOW k AS (PARTITION BY member_id, metric, period_key, source, observed_at)
QUALIFY row_number() OVER (PARTITION BY member_id, metric, period_key, source, observed_at ORDER BY confidence DESC, arrival) = 1)"""


@query(f"WITH {UPSERT_SQL} SELECT member_id, metric, period_key, source, observed_at, value, round(CAST(confidence AS DOUBLE), 2) AS confidence, fact_id, reads FROM up")
def o_ups_confidence_upsert(spark, d):
    return facts.upsert(fact_rows(spark, d)).select(*facts.KEY, "value", F.round(F.col("confidence").cast("double"), 2).alias("confidence"), "fact_id", "reads")


LIVE = f"""{UPSERT_SQL}, live AS (SELECT * FROM up WHERE fact_id NOT IN (SELECT fact_id FROM up WHERE fact_id % 7 = 0))"""


def _live(spark, d):
    up = facts.upsert(fact_rows(spark, d))
    return facts.live(up, up.where("fact_id % 7 = 0").select("fact_id", (F.col("fact_id") + 1).alias("superseded_by")))


@query(f"""WITH {LIVE}, t AS (SELECT l.metric, s_name AS member, n_name AS nation, member_id, CAST(round(sum(value), 2) AS DOUBLE) AS total FROM live l JOIN supplier ON member_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT metric, member, nation, member_id, total, row_number() OVER (PARTITION BY metric ORDER BY total DESC, member_id) AS rank FROM t""")
def live_leaderboard(spark, d):
    """O-UPS, O-SUP, J-OWN, F-PER and M-LDR end to end."""
    dims = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    rows = _live(spark, d).join(dims, F.col("member_id") == F.col("s_suppkey"))
    totals = rows.groupBy("metric", F.col("s_name").alias("member"), F.col("n_name").alias("nation"), "member_id").agg(F.round(F.sum("value"), 2).alias("total"))
    return facts.leaderboard(totals, ["metric"], "total")


@query(f"WITH {LIVE} SELECT metric, period_key, count(*) AS n, min(value) AS lo, max(value) AS hi FROM live GROUP BY ALL")
def p_live_by_period(spark, d):
    return _live(spark, d).groupBy("metric", "period_key").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query(f"""WITH {LIVE} SELECT member_id, value, fact_id FROM live WHERE metric = 'R' AND period_key = '1997-W20' ORDER BY value DESC, fact_id""")
def p_live_of_period(spark, d):
    """P-LIVE and O-VAL: the live facts of one metric and period, largest first."""
    return _live(spark, d).where("metric = 'R' and period_key = '1997-W20'").select("member_id", "value", "fact_id").orderBy(F.desc("value"), "fact_id")


@query("""SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS alias, min(o_orderkey) AS first_seen FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey % 3 <> 0 GROUP BY ALL""")
def o_als_alias_insert(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    new = c.join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", names.ascii_normal("c_name").alias("alias"), F.col("o_orderkey").alias("first_seen"))
    have = c.where("c_custkey % 3 = 0").select("c_custkey", names.ascii_normal("c_name").alias("alias"))
    return facts.insert_absent(have, new, ["c_custkey", "alias"], ["first_seen"])


@query("""WITH o AS (SELECT c_custkey AS k, c_acctbal AS price, c_mktsegment AS brand FROM customer), n AS (SELECT o_custkey + CASE WHEN o_custkey % 3 = 0 THEN 10000000 ELSE 0 END AS k, CASE WHEN o_custkey % 5 <> 0 THEN max(o_totalprice) END AS price, 'new' AS brand FROM orders GROUP BY o_custkey) SELECT coalesce(o.k, n.k) AS k, coalesce(n.price, o.price) AS price, coalesce(o.brand, n.brand) AS brand FROM o FULL JOIN n ON o.k = n.k""")
def o_adv_coalesce_upsert(spark, d):
    """All customers refreshed by all orders: a third of the changes are of new keys, a fifth bring no value."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("price"), F.col("c_mktsegment").alias("brand"))
    new = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("price"))
    new = new.select((F.col("o_custkey") + F.when(F.col("o_custkey") % 3 == 0, 10_000_000).otherwise(0)).alias("k"), F.when(F.col("o_custkey") % 5 != 0, F.col("price")).alias("price"), F.lit("new").alias("brand"))
    return facts.refresh(old, new, ["k"], ["price"], ["brand"])


SETTLED_SQL = """WITH r AS (SELECT o_orderkey AS review_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'resolved' ELSE 'rejected' END AS status FROM orders), d AS (SELECT l_orderkey AS review_id, arg_min(CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'resolved' END, l_linenumber) AS verdict, arg_min(l_suppkey, l_linenumber) AS member_id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'resolved' END, l_suppkey) AS rn FROM lineitem) WHERE rn = 1 GROUP BY 1)
SELECT r.review_id, CASE WHEN status = 'pending' AND verdict IS NOT NULL AND verdict = 'resolved' THEN member_id END AS resolved_member, CASE WHEN status = 'pending' AND verdict IS NOT NULL THEN verdict ELSE status END AS status FROM r LEFT JOIN d USING (review_id)"""


@query(SETTLED_SQL)
def o_res_settle_reviews(spark, d):
    return _settled(spark, d)


def _settled(spark, d):
    reviews = table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "resolved").otherwise("rejected").alias("status"))
    li = table(spark, d, "lineitem")
    first = li.groupBy(F.col("l_orderkey").alias("review_id")).agg(F.min(F.struct(F.col("l_linenumber").alias("decided_at"), F.when(F.col("l_returnflag") == "R", "rejected").otherwise("resolved").alias("verdict"), F.col("l_suppkey").alias("member_id"))).alias("f")).select("review_id", "f.*")
    return facts.settle_reviews(reviews, first)


@query(f"""WITH s AS ({SETTLED_SQL}), n AS (SELECT resolved_member AS member_id, 'Row #' || CAST(o_custkey % 9 AS VARCHAR) AS alias, 'row' || CAST(o_custkey % 9 AS VARCHAR) AS alias_normalized, review_id FROM s JOIN orders ON o_orderkey = review_id WHERE resolved_member IS NOT NULL)
SELECT member_id, arg_min(alias, review_id) AS alias, alias_normalized, 'review' AS source FROM n WHERE NOT (member_id % 3 = 0 AND alias_normalized = 'row' || CAST(member_id % 9 AS VARCHAR)) GROUP BY member_id, alias_normalized""")
def o_res_aliases(spark, d):
    """The aliases that settling adds, where every third member has one already."""
    raw = table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"), F.concat(F.lit("Row #"), (F.col("o_custkey") % 9).cast("string")).alias("raw_text"))
    have = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("member_id"), F.concat(F.lit("row"), (F.col("s_suppkey") % 9).cast("string")).alias("alias_normalized"))
    return facts.resolution_aliases(_settled(spark, d).join(raw, "review_id"), have, names.ascii_normal("raw_text"))


# functions


@query("""SELECT p_partkey, CAST(round((p_retailprice / 10) * 10) / 10 AS DOUBLE) AS shown, CAST(round(CAST(printf('%.1f', round(p_retailprice) / 10) AS DOUBLE) * 1000) AS BIGINT) AS power, p_size AS level, CASE p_size % 4 WHEN 0 THEN 0.0 WHEN 1 THEN p_size / 60.0 WHEN 2 THEN CAST(p_size AS DOUBLE) ELSE p_size * 24.0 END AS hours, CAST(floor(p_retailprice * 100) AS BIGINT) AS points, p_size + 1 AS total, p_name AS group_name FROM part""")
def f_parse_round_trip(spark, d):
    """Fields rendered as a game would show them, and read back."""
    p = table(spark, d, "part")
    power = F.concat(F.lit("Power: "), F.format_string("%.1f", F.round(F.col("p_retailprice")) / 10), F.lit("K"))
    seen = F.when(F.col("p_size") % 4 == 0, "Online").when(F.col("p_size") % 4 == 1, F.format_string("%dm ago", "p_size")).when(F.col("p_size") % 4 == 2, F.format_string("%dh ago", "p_size")).otherwise(F.format_string("%dd", "p_size"))
    grouped = F.format_string("%,d", F.floor(F.col("p_retailprice") * 100))
    header = parse.group_header(F.format_string("%s 1/%d", F.col("p_name"), F.col("p_size") + 1))
    return p.select("p_partkey", (F.round(F.col("p_retailprice") / 10 * 10) / 10).alias("shown"), parse.power(power).alias("power"), parse.level(F.format_string("Lv. %d", "p_size")).alias("level"), parse.last_active_hours(seen).alias("hours"), parse.points(grouped).alias("points"), header["total"].alias("total"), header["name"].alias("group_name"))


REJECTS = ["12", "1234", "1,234", "12,34", "1,234,567", " 9 ", "12.3M", "power: 1.0b", "12.34M", "1.0T", "Lv.30", "lv 7", "lv", "Online now", "3h ago", "4d", "x ago", "Raiders 3/25", "A 1/2 3/4", "B 5/4", "Members: 71 / 100", "Members: 71/100", "Lv LV30", "Lv lv30", "LV. 8", "1O5", "12\n", ""]


@query("""SELECT * FROM (VALUES ('12', NULL, 12, NULL, NULL), ('1234', NULL, NULL, NULL, NULL), ('1,234', NULL, 1234, NULL, NULL), ('12,34', NULL, NULL, NULL, NULL), ('1,234,567', NULL, 1234567, NULL, NULL), (' 9 ', NULL, 9, NULL, NULL), ('12.3M', 12300000, NULL, NULL, NULL), ('power: 1.0b', 1000000000, NULL, NULL, NULL), ('12.34M', NULL, NULL, NULL, NULL), ('1.0T', NULL, NULL, NULL, NULL), ('Lv.30', NULL, NULL, 30, NULL), ('lv 7', NULL, NULL, 7, NULL), ('lv', NULL, NULL, NULL, NULL), ('Online now', NULL, NULL, NULL, NULL), ('3h ago', NULL, NULL, NULL, NULL), ('4d', NULL, NULL, NULL, NULL), ('x ago', NULL, NULL, NULL, NULL), ('Raiders 3/25', NULL, NULL, NULL, 25), ('A 1/2 3/4', NULL, NULL, NULL, NULL), ('B 5/4', NULL, NULL, NULL, NULL), ('Members: 71 / 100', NULL, NULL, NULL, NULL), ('Members: 71/100', NULL, NULL, NULL, 100), ('Lv LV30', NULL, NULL, NULL, NULL), ('Lv lv30', NULL, NULL, 30, NULL), ('LV. 8', NULL, NULL, 8, NULL), ('1O5', NULL, NULL, NULL, NULL), ('12' || chr(10), NULL, 12, NULL, NULL), ('', NULL, NULL, NULL, NULL)) t(raw, power, points, level, total)""")
def f_parse_rejects(spark, d):
    df = spark.createDataFrame([(x,) for x in REJECTS], "raw string")
    return df.select("raw", parse.power("raw").alias("power"), parse.points("raw").alias("points"), parse.level("raw").alias("level"), parse.group_header("raw")["total"].alias("total"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(dayofweek(o_orderdate) AS INTEGER) AS weekday FROM orders""")
def f_per_period_keys(spark, d):
    return table(spark, d, "orders").select("o_orderkey", parse.period_key("o_orderdate").alias("week"), parse.period_key("o_orderdate", weekly=False).alias("day"), (F.dayofweek("o_orderdate") - 1).alias("weekday"))


@query("""WITH t AS (SELECT p_partkey, CAST(floor(p_retailprice * 1000) AS BIGINT) AS v, p_size AS w FROM part), c AS (SELECT p_partkey, list_filter(list_transform(range(10), lambda x: v - v // 10 % 10 * 10 + x * 10), lambda y: y BETWEEN v - w AND v + w) AS fits FROM t) SELECT p_partkey, CASE WHEN len(fits) = 1 THEN fits[1] END AS repaired FROM c""")
def f_rep_repaired_points(spark, d):
    """The tens digit of each number is damaged; bounds of 1 to 50 each way leave one reading, or several, which are refused."""
    t = table(spark, d, "part").select("p_partkey", F.floor(F.col("p_retailprice") * 1000).alias("v"), "p_size")
    shown = F.format_string("%,d", "v")
    broken = F.concat(F.expr("substring(s, 1, length(s) - 2)"), F.lit("?"), F.expr("substring(s, -1, 1)"))
    return t.withColumn("s", shown).select("p_partkey", parse.repaired_points(broken, F.col("v") - F.col("p_size"), F.col("v") + F.col("p_size")).alias("repaired"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber - 3 <= 0 THEN 0 ELSE 3600 * (CAST(pow(2, least(l_linenumber - 3, 5)) AS BIGINT) - 1) END AS BIGINT) AS backoff, CASE WHEN l_discount = 0 THEN l_tax = 0 ELSE abs(l_tax - l_discount) / l_discount <= 0.5 END AS near FROM lineitem""")
def f_bko_backoff_and_tolerance(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", parse.backoff(F.lit(3600), F.col("l_linenumber") - 3).alias("backoff"), parse.near("l_tax", "l_discount", 0.5).alias("near"))


@query("""SELECT doc_id, regexp_replace(lower(lang || ':' || source), '[^0-9]', '', 'g') AS digits, translate(source, 'sr', '') AS bare, coalesce(nullif(n_chars % 3, 0), -1) AS rest FROM documents""")
def f_strings(spark, d):
    return table(spark, d, "documents").select("doc_id", parse.digits(F.concat_ws(":", "lang", "source")).alias("digits"), parse.without("source", "sr").alias("bare"), F.coalesce(parse.null_if_zero(F.col("n_chars") % 3), F.lit(-1)).alias("rest"))


# sources


@query("""SELECT sha256(text) AS hash, 'sha256/' || sha256(text)[1:2] || '/' || sha256(text)[3:4] || '/' || sha256(text) AS key, min(doc_id) AS first_doc, count(*) AS observations FROM documents GROUP BY text""")
def s_key_content_addresses(spark, d):
    docs = table(spark, d, "documents").select("doc_id", blobs.digest("text").alias("hash"))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("observations")).withColumn("key", blobs.key(F.col("hash")))


@query("""SELECT DISTINCT sha256(text) AS key FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)""")
def s_put_missing_blobs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", blobs.digest("text").alias("key"))
    return blobs.missing(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0")).select("key")


@query("""SELECT doc_id, doc_id % 10 <> 3 AS intact FROM documents""")
def s_get_verified(spark, d):
    docs = table(spark, d, "documents").withColumn("want", F.when(F.col("doc_id") % 10 == 3, blobs.digest(F.concat("text", F.lit("!")))).otherwise(blobs.digest("text")))
    return blobs.verified(docs, "text", "want").select("doc_id", "intact")


@query("""SELECT l_orderkey AS read, coalesce(string_agg(CASE WHEN l_tax > 0.02 THEN l_returnflag || l_linenumber END, ' ' ORDER BY l_linenumber, l_suppkey, l_returnflag), '') AS text, coalesce(round(avg(CASE WHEN l_tax > 0.02 THEN l_quantity END) / 100, 6), 0.0) AS confidence FROM lineitem GROUP BY 1""")
def s_tsv_recognised_words(spark, d):
    li = table(spark, d, "lineitem")
    line = F.concat(F.lit("5\t1\t1\t1\t1\t1\t0\t0\t0\t0\t"), F.when(F.col("l_tax") > 0.02, F.col("l_quantity").cast("string")).otherwise("-1"), F.lit("\t"), F.col("l_returnflag"), F.col("l_linenumber").cast("string"))
    return recognised.words(li.select(F.col("l_orderkey").alias("read"), F.struct("l_linenumber", "l_suppkey").alias("n"), line.alias("line")), "read", "n")


NAMES_SQL = "CASE doc_id % 5 WHEN 0 THEN sha256(text) WHEN 1 THEN upper(sha256(text)) WHEN 2 THEN sha256(text) || chr(10) WHEN 3 THEN '_' || lang ELSE lang || '-' || source END"


@query(f"""SELECT doc_id, regexp_full_match({NAMES_SQL}, '_?[a-z0-9][a-z0-9_]*') AS label, regexp_full_match({NAMES_SQL}, '[0-9a-f]{{64}}') AS hash FROM documents""")
def s_lab_labels(spark, d):
    """Digests, digests in capitals or with a line feed, labels and what is neither."""
    sha, kind = F.sha2("text", 256), F.col("doc_id") % 5
    name = F.when(kind == 0, sha).when(kind == 1, F.upper(sha)).when(kind == 2, F.concat(sha, F.lit("\n"))).when(kind == 3, F.concat(F.lit("_"), "lang")).otherwise(F.concat_ws("-", "lang", "source"))
    return table(spark, d, "documents").select("doc_id", blobs.is_label(name).alias("label"), blobs.is_hash(name).alias("hash"))


@query("""SELECT text, count(DISTINCT source) AS labels FROM documents GROUP BY text HAVING count(DISTINCT source) > 1""")
def a_dup_labels(spark, d):
    return table(spark, d, "documents").groupBy("text").agg(F.count_distinct("source").alias("labels")).where("labels > 1")


# joins


@query("""SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')""")
def j_own_chain(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    dims = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).where(F.col("r_name").isin("ASIA", "EUROPE"))
    return table(spark, d, "customer").join(dims, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")


@query("""SELECT o_custkey AS member_id, string_agg(o_orderpriority, '|' ORDER BY o_orderdate, o_orderkey) AS aliases FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1""")
def j_ali_aliases_in_order(spark, d):
    active = table(spark, d, "customer").where("c_acctbal > 0")
    rows = table(spark, d, "orders").join(active, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("o_custkey").alias("member_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]), "|").alias("aliases"))


@query("""WITH marks AS (SELECT user_id, event_id, epoch_us(ts) AS at, event_type AS mark FROM events WHERE event_type IN ('purchase', 'signup')) SELECT e.event_id, coalesce(arg_max(m.mark, (m.at, m.event_id)), 'none') AS mark FROM events e LEFT JOIN marks m ON m.user_id = e.user_id AND m.at <= epoch_us(e.ts) WHERE e.event_type = 'view' GROUP BY e.event_id""")
def j_ownr_as_of(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    marks = ev.where(F.col("event_type").isin("purchase", "signup")).select("user_id", "at", F.col("event_type").alias("mark"))
    return sequences.as_of(ev.where("event_type = 'view'"), marks, ["user_id"], "at", "mark", "none").select("event_id", "mark")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def j_anti_without_row(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_anti").select("c_custkey")


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey AND a.p_size < b.p_size + 5 AND b.p_size < a.p_size + 5""")
def j_ovl_overlaps(spark, d):
    """Intervals of five around a size, in one dimension: a row meets the ones of its own size, and those up to four sizes larger, so nearly every pair that is met is told."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    a = p.alias("a")
    b = p.select("p_partkey", "p_brand", "p_type", F.explode(F.array(*(F.struct((F.col("p_size") - k).alias("p_size"), F.lit(k).alias("more")) for k in range(5)))).alias("s")).select("p_partkey", "p_brand", "p_type", "s.*").alias("b")
    met = a.join(b.hint("merge"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("p_brand", "p_type", "p_size")])  # five rows for each, which the planner's estimate doesn't know
    met = met.where((F.col("b.more") > 0) | (F.col("a.p_partkey") < F.col("b.p_partkey")))
    return met.select(F.least("a.p_partkey", "b.p_partkey").alias("a"), F.greatest("a.p_partkey", "b.p_partkey").alias("b"))


@query("""WITH r AS (SELECT n_nationkey AS nation, n_name AS stored, lower(replace(n_name, 'I', '1')) AS read FROM nation), s AS (SELECT a.nation, b.nation AS member_id, CAST(CASE WHEN greatest(length(a.read), length(lower(b.stored))) = 0 THEN 100 ELSE floor(100 * (greatest(length(a.read), length(lower(b.stored))) - levenshtein(a.read, lower(b.stored))) / greatest(length(a.read), length(lower(b.stored)))) END AS INTEGER) AS score FROM r a JOIN r b ON true) SELECT nation, arg_max(member_id, (score, -member_id)) AS best, max(score) AS score FROM s GROUP BY 1""")
def er_rank_unit_cost(spark, d):
    """Reads of the 25 nation names against all of them, blocked by a constant: the closed set of one capture."""
    n = table(spark, d, "nation").select(F.lit(1).alias("capture"), "n_nationkey", "n_name")
    reads = n.select("capture", F.col("n_nationkey").alias("nation"), F.lower(F.replace("n_name", F.lit("I"), F.lit("1"))).alias("read"))
    members = n.select("capture", F.col("n_nationkey").alias("member_id"), F.lower("n_name").alias("name"))
    scored = reads.join(members, "capture").withColumn("score", names.edit_ratio("read", "name"))
    return scored.groupBy("nation").agg(F.max_by("member_id", F.struct("score", -F.col("member_id"))).alias("best"), F.max("score").alias("score"))


@query(f"""WITH s AS (SELECT s_nationkey, s_suppkey, lower(replace(s_name, '#', '')) AS name, translate(s_name, '01', 'Oi') AS read FROM supplier), p AS (SELECT a.read, b.s_suppkey AS member_id, {weighted_sql("lower(replace(a.read, '#', ''))", "b.name")} AS score FROM s a JOIN s b USING (s_nationkey))
SELECT read, arg_max(member_id, (score, -member_id)) AS member_id, max(score) AS score FROM p GROUP BY read""")
def er_rank_weighted(spark, d):
    """Names with look-alike swaps against the suppliers of their nation; scores know the swaps."""
    s = table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("member_id"), "s_name")
    reads = s.select("s_nationkey", F.translate("s_name", "01", "Oi").alias("read"))
    tops = nearest.nearest(reads, s, ["s_nationkey"], "read", "s_name", names.likeness, likely.forms)
    best = tops.join(s, ["s_nationkey", "s_name"])
    return best.groupBy("read").agg(F.max_by("member_id", F.struct("score", -F.col("member_id"))).alias("member_id"), F.max("score").alias("score"))


WORDS_SQL = "array_to_string(list_sort(string_split(lower({a}), ' ')), ' ')"
PLAIN_SQL = "replace(lower({a}), ' ', '')"


@query(f"""WITH m AS (SELECT p_size % 5 AS shelf, p_partkey AS member_id, unnest(CASE WHEN p_partkey % 3 = 0 THEN [p_name, p_name || ' ' || p_brand] ELSE [p_name] END) AS name FROM part),
r AS (SELECT DISTINCT p_size % 5 AS shelf, translate(string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1], 'ol', '01') AS read FROM part),
q AS (SELECT read, name, greatest({weighted_sql("x", "y")}, {weighted_sql("v", "w")}) AS score FROM (SELECT DISTINCT read, name, {PLAIN_SQL.format(a="read")} AS x, regexp_replace({PLAIN_SQL.format(a="name")}, '[^a-z0-9]', '', 'g') AS y, {WORDS_SQL.format(a="read")} AS v, {WORDS_SQL.format(a="regexp_replace(name, '[^A-Za-z0-9 ]', '', 'g')")} AS w FROM r JOIN m USING (shelf)))
SELECT shelf, read, member_id, max(score) AS score FROM r JOIN m USING (shelf) JOIN q USING (read, name) WHERE score >= 75 GROUP BY ALL""")
def j_rank_likely_names(spark, d):
    """J-RANK: names of two words, read the other way round and with look-alikes, against the parts of their shelf, by name and alias; every pair that a person would look at."""
    p = table(spark, d, "part").select((F.col("p_size") % 5).alias("shelf"), F.col("p_partkey").alias("member_id"), "p_name", F.when(F.col("p_partkey") % 3 == 0, F.array(F.concat_ws(" ", "p_name", "p_brand"))).alias("aliases"))
    read = F.translate(F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1))), "ol", "01")
    return likely.likely(p.select("shelf", read.alias("read")), p, ["shelf"], "read", "p_name", aliases="aliases")


CLAIMS_SQL = """n AS (SELECT g, count(DISTINCT member) AS n FROM cells GROUP BY g), acc AS (SELECT g, row, coalesce(list(member) FILTER (score >= 92), []) AS ms FROM cells GROUP BY g, row),
st AS (SELECT g, 1 AS phase, CAST([] AS BIGINT[]) AS gone, CAST([] AS BIGINT[]) AS mems, CAST([] AS BIGINT[]) AS first, CAST(NULL AS BIGINT) AS row, CAST(NULL AS BIGINT) AS member, CAST(NULL AS INTEGER) AS score FROM n
UNION ALL SELECT g, CASE WHEN b IS NULL THEN phase + 1 ELSE phase END, CASE WHEN b IS NULL THEN gone ELSE list_append(gone, b.row) END, CASE WHEN b IS NULL THEN mems ELSE list_append(mems, b.member) END, CASE WHEN b IS NULL AND phase = 1 THEN mems ELSE first END, b.row, b.member, b.score
FROM (SELECT g, phase, gone, mems, first, arg_max(struct_pack(row := row, member := member, score := score), (score, -row)) FILTER (k = 1 AND score >= CASE phase WHEN 1 THEN 92 ELSE 60 END AND (free = 1 OR score - next >= CASE phase WHEN 1 THEN 1 ELSE 20 END)) AS b
FROM (SELECT st.g, phase, gone, mems, first, c.row, c.member, c.score, row_number() OVER w AS k, coalesce(lead(c.score) OVER w, 0) AS next, n.n - len(mems) AS free FROM st JOIN cells c ON c.g = st.g JOIN n ON n.g = st.g JOIN acc ON acc.g = st.g AND acc.row = c.row
WHERE phase <= 2 AND NOT list_contains(gone, c.row) AND NOT list_contains(mems, c.member) AND (phase = 1 OR NOT list_has_any(acc.ms, first)) WINDOW w AS (PARTITION BY st.g, c.row ORDER BY c.score DESC, c.member)) GROUP BY g, phase, gone, mems, first)),
taken AS (SELECT g, phase, row, member, score FROM st WHERE row IS NOT NULL), sure AS (SELECT g, list(member) AS ms FROM taken WHERE phase = 1 GROUP BY g)"""


@query(f"""WITH RECURSIVE s AS (SELECT s_nationkey, s_suppkey, lower(replace(s_name, '#', '')) AS name, translate(s_name, '01', 'Oi') AS read FROM supplier),
cells AS (SELECT a.s_nationkey AS g, a.s_suppkey AS row, b.s_suppkey AS member, {weighted_sql("lower(replace(a.read, '#', ''))", "b.name")} AS score FROM s a JOIN s b USING (s_nationkey)), {CLAIMS_SQL}
SELECT acc.g AS s_nationkey, CAST(acc.row AS INTEGER) AS row, CAST(coalesce(t.member, -1) AS INTEGER) AS member, coalesce(t.score, 0) AS score, CASE WHEN t.phase IS NOT NULL THEN t.phase WHEN list_has_any(acc.ms, coalesce(sure.ms, [])) THEN 3 ELSE 0 END AS phase FROM acc LEFT JOIN taken t ON t.g = acc.g AND t.row = acc.row LEFT JOIN sure ON sure.g = acc.g""")
def er_asn_assignment(spark, d):
    """Closed-set assignment per nation of perturbed supplier names, without all pairs of a nation."""
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    rows = s.select("s_nationkey", F.col("s_suppkey").cast("int").alias("row"), F.translate("s_name", "01", "Oi").alias("read"))
    members = s.select("s_nationkey", F.col("s_suppkey").cast("int").alias("member"), "s_name")
    return claims.named(rows, members, "s_nationkey", "read", "s_name", names.likeness, likely.forms)


@query("""WITH RECURSIVE cells AS (SELECT o_orderkey AS g, l_linenumber::BIGINT AS row, (l_linenumber + k) % 5 AS member, max(CAST(55 + (l_suppkey * (7 + k) + l_partkey * (3 + 2 * k) + l_linenumber) % 46 AS INTEGER)) AS score FROM (SELECT *, l_orderkey AS o_orderkey FROM lineitem), (VALUES (0), (1), (2)) t(k) GROUP BY ALL), """ + CLAIMS_SQL + """
SELECT acc.g AS o_orderkey, CAST(acc.row AS INTEGER) AS row, CAST(coalesce(t.member, -1) AS INTEGER) AS member, coalesce(t.score, 0) AS score, CASE WHEN t.phase IS NOT NULL THEN t.phase WHEN list_has_any(acc.ms, coalesce(sure.ms, [])) THEN 3 ELSE 0 END AS phase FROM acc LEFT JOIN taken t ON t.g = acc.g AND t.row = acc.row LEFT JOIN sure ON sure.g = acc.g""")
def er_asn_contested(spark, d):
    """The same where the lines of each order contest five members: ties, rows that are second sightings, and claims from what is left."""
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    n, k = F.col("l_linenumber"), F.col("k")
    score = (55 + (F.col("l_suppkey") * (7 + k) + F.col("l_partkey") * (3 + 2 * k) + n) % 46).cast("int")
    return claims.assignments(li.select("o_orderkey", n.cast("int").alias("row"), ((n + k) % 5).cast("int").alias("member"), score.alias("score")), "o_orderkey")


# aggregates and windows


@query(f"""WITH {RUNS_SQL}, l AS (SELECT account_id, task, max(started_at) FILTER (status IN ('succeeded', 'failed')) AS last_run, max(started_at) FILTER (status = 'succeeded') AS last_success FROM runs GROUP BY 1, 2) SELECT account_id, task, last_run, last_success, (SELECT count(*) FROM runs r WHERE r.account_id = l.account_id AND r.task = l.task AND r.status = 'failed' AND (l.last_success IS NULL OR r.started_at > l.last_success)) AS failures FROM l""")
def a_cf_run_state(spark, d):
    return planner.run_state(run_rows(spark, d))


@query(f"""WITH {RUNS_SQL} SELECT task, count(*) FILTER (status = 'succeeded') AS ok, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'paused') AS paused, count(*) FILTER (status = 'running') AS stuck, count(*) AS total, round(100.0 * count(*) FILTER (status = 'succeeded') / count(*), 1) AS pct FROM runs WHERE started_at > (SELECT max(started_at) FROM runs) - 86400000000 GROUP BY 1""")
def a_gate_recent_runs(spark, d):
    """The last 24 hours before the newest run; what is still running counts as stuck."""
    r = run_rows(spark, d)
    end = r.agg(F.max("started_at").alias("end"))
    of = lambda status: F.count_if(F.col("status") == status)
    counts = [of(s).alias(c) for s, c in (("succeeded", "ok"), ("failed", "failed"), ("paused", "paused"), ("running", "stuck"))]
    return r.join(F.broadcast(end), F.col("started_at") > F.col("end") - F.lit(86_400_000_000)).groupBy("task").agg(*counts, F.count("*").alias("total"), F.round(100.0 * of("succeeded") / F.count("*"), 1).alias("pct"))


@query("""SELECT CAST(quality AS VARCHAR) AS label, CASE WHEN toxic = 1 THEN '<none>' ELSE CAST(quality AS VARCHAR) END AS predicted, count(*) AS n FROM labels GROUP BY ALL""")
def a_cm_confusion(spark, d):
    df = table(spark, d, "labels").select(F.col("quality").cast("string").alias("q"), F.when(F.col("toxic") == 1, "").otherwise(F.col("quality").cast("string")).alias("p"))
    return evaluate.confusion(df, "q", "p")


@query("""SELECT count(*) AS total, count(*) FILTER (CASE WHEN quality = 0 THEN toxic = 1 ELSE toxic = 0 END) AS correct, round(count(*) FILTER (CASE WHEN quality = 0 THEN toxic = 1 ELSE toxic = 0 END) / count(*), 6) AS accuracy FROM labels""")
def a_acc_accuracy(spark, d):
    df = table(spark, d, "labels").select(F.when(F.col("quality") == 0, "_none").otherwise("good").alias("q"), F.when(F.col("toxic") == 1, "").otherwise("good").alias("p"))
    return evaluate.accuracy(df, "q", "p")


@query("""WITH s AS (SELECT p_brand AS anchor, CASE WHEN p_size % 2 = 0 THEN 'ECONOMY' ELSE 'SMALL' END AS screen, p_type, CASE WHEN p_size % 2 = 0 AND p_type = 'ECONOMY' AND p_brand LIKE '%1' THEN 0.98 ELSE p_size / 60.0 END AS score FROM part), a AS (SELECT anchor, screen, count(*) FILTER (p_type = screen) AS in_count, count(*) FILTER (p_type <> screen) AS out_count, coalesce(least(1.0, min(score) FILTER (p_type = screen)), 0.0) AS worst_in, greatest(0.0, coalesce(max(score) FILTER (p_type <> screen), 0.0)) AS best_out FROM s GROUP BY ALL) SELECT anchor, screen, in_count, out_count, round(CAST(worst_in AS DOUBLE), 6) AS worst_in, round(CAST(best_out AS DOUBLE), 6) AS best_out, round(CASE WHEN in_count > 0 THEN worst_in - best_out ELSE 0 END, 6) AS gap, round(CASE WHEN in_count > 0 AND worst_in > best_out THEN (worst_in + best_out) / 2 ELSE 0 END, 6) AS suggested, in_count = 0 OR worst_in <= best_out AS overlap FROM a""")
def a_sep_separation(spark, d):
    """Anchors are brands, screens two types; a few brands are told apart, so that both kinds of gap occur."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("anchor"), F.when(F.col("p_size") % 2 == 0, "ECONOMY").otherwise("SMALL").alias("screen"), "p_type", "p_size")
    clear = (F.col("screen") == "ECONOMY") & (F.col("p_type") == "ECONOMY") & F.col("anchor").endswith("1")
    scored = p.withColumn("score", F.when(clear, 0.98).otherwise(F.col("p_size") / 60.0))
    got = evaluate.separation(scored, ["anchor", "screen"], F.col("p_type") == F.col("screen"), "score")
    return got.select("anchor", "screen", "in_count", "out_count", *(F.round(c, 6).alias(c) for c in ("worst_in", "best_out", "gap", "suggested")), "overlap")


@query("""WITH s AS (SELECT l_orderkey AS frame, l_returnflag AS screen, min(l_quantity) AS confidence FROM lineitem GROUP BY ALL HAVING bool_and(l_quantity >= l_linenumber * 2)) SELECT frame, arg_min(screen, (-confidence, screen)) AS screen, max(confidence) AS confidence FROM s GROUP BY 1""")
def a_arg_recognised_screen(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_returnflag").alias("screen"), F.col("l_quantity").alias("score"), (F.col("l_linenumber") * 2).alias("thr"))
    return evaluate.recognised(li, "frame", "screen", "score", "thr")


@query("""SELECT l_orderkey, l_linestatus AS text, l_discount AS confidence, l_linenumber * 1000000 + l_suppkey AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber * 1000000 + l_suppkey, l_linestatus) AS rn FROM lineitem) WHERE rn = 1""")
def a_best_read(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("text"), F.col("l_discount").alias("confidence"), (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("n"))
    return evaluate.best_read(li, ["l_orderkey"], "text", "confidence", "n")


@query("""WITH t AS (SELECT o_custkey AS g, o_orderkey AS n, CAST(floor(o_totalprice) AS BIGINT) AS v, o_orderstatus <> 'P' AS known FROM orders) SELECT g, n, coalesce(last_value(CASE WHEN known THEN v END IGNORE NULLS) OVER (PARTITION BY g ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9223372036854775807) AS hi, coalesce(first_value(CASE WHEN known THEN v END IGNORE NULLS) OVER (PARTITION BY g ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS lo FROM t""")
def w_bnd_neighbour_bounds(spark, d):
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("n"), F.floor("o_totalprice").alias("v"), (F.col("o_orderstatus") != "P").alias("known"))
    return sequences.neighbour_bounds(t, ["g"], ["n"], "v", "known").select("g", "n", "hi", "lo")


LNIS_SQL = """WITH RECURSIVE t AS (SELECT o_custkey AS g, o_orderkey AS n, CAST(floor(o_totalprice) AS BIGINT) AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
f AS (SELECT g, k, [v] AS vs, [1] AS ls, [0] AS bs FROM t WHERE k = 1 UNION ALL
SELECT t.g, t.k, vs || [t.v], ls || [1 + coalesce(list_max(list_transform(list_filter(range(1, t.k), lambda i: vs[i] >= t.v), lambda i: ls[i])), 0)], bs || [coalesce(list_filter(range(1, t.k), lambda i: vs[i] >= t.v AND ls[i] = list_max(list_transform(list_filter(range(1, t.k), lambda j: vs[j] >= t.v), lambda j: ls[j])))[1], 0)] FROM f JOIN t ON t.g = f.g AND t.k = f.k + 1),
last AS (SELECT g, ls, bs FROM f QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC) = 1),
path AS (SELECT g, bs, list_position(ls, list_max(ls)) AS pos FROM last UNION ALL SELECT g, bs, bs[pos] FROM path WHERE bs[pos] > 0)
SELECT t.g, n, v, p.g IS NOT NULL AS keep FROM t LEFT JOIN path p ON t.g = p.g AND t.k = p.pos"""


@query(LNIS_SQL)
def w_lnis_consistent_seeds(spark, d):
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("n"), F.floor("o_totalprice").alias("v"))
    return sequences.consistent(t, ["g"], ["n"], "v")


@query("""WITH RECURSIVE t AS (SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey AS s, l_quantity AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity) AS k FROM lineitem), f AS (SELECT o, k, y AS last, true AS accepted FROM t WHERE k = 1 UNION ALL SELECT t.o, t.k, CASE WHEN t.y > f.last + 8 THEN t.y ELSE f.last END, t.y > f.last + 8 FROM f JOIN t ON t.o = f.o AND t.k = f.k + 1) SELECT t.o AS l_orderkey, n AS l_linenumber, s AS l_suppkey, y AS l_quantity, accepted FROM t JOIN f ON t.o = f.o AND t.k = f.k""")
def w_ded_spaced_rows(spark, d):
    """Rows of an order kept when they lie more than 8 beyond the last one kept."""
    return sequences.spaced(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), ["l_orderkey"], ["l_linenumber", "l_suppkey", "l_quantity"], "l_quantity", 8)


OFFSETS = "SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS off, event_type <> 'error' AS present, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events"


@query(f"""WITH t AS ({OFFSETS}), g AS (SELECT *, lag(present, 1, false) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM t) SELECT event_id, CAST(sum(off) OVER w - first_value(off) OVER w AS BIGINT) AS content_y, CAST(sum(CASE WHEN present AND before THEN off ELSE 0 END) OVER w AS BIGINT) AS group_y FROM g WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w_cum_offsets(spark, d):
    t = table(spark, d, "events").select("event_id", "user_id", F.floor("value").alias("off"), (F.col("event_type") != "error").alias("present"))
    return sequences.group_offset(sequences.content_offset(t, ["user_id"], ["event_id"], "off"), ["user_id"], ["event_id"], "off", "present").select("event_id", "content_y", "group_y")


@query("""WITH t AS (SELECT user_id, event_id, event_type IN ('error', 'view') AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM t WHERE f) SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM g GROUP BY user_id, grp""")
def w_run_islands(spark, d):
    t = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").isin("error", "view").alias("f"))
    return sequences.runs(t, ["user_id"], "event_id", "f")


@query("""WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_type IN ('error', 'view', 'click') THEN 0 ELSE CAST(floor(value) AS BIGINT) + 1 END AS off FROM events), m AS (SELECT *, sum(CASE WHEN off = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM t), a AS (SELECT user_id, min(n) FILTER (s = 3) AS done_at, min(n) FILTER (off > 140) AS far, count(*) AS frames FROM m GROUP BY 1) SELECT user_id, done_at, frames, CASE WHEN far <= 40 AND (done_at IS NULL OR far < done_at) THEN 'overshot' WHEN done_at <= 40 THEN 'complete' ELSE 'incomplete' END AS status FROM a""")
def w_scr_scroll_status(spark, d):
    t = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("error", "view", "click"), 0).otherwise(F.floor("value") + 1).alias("off"))
    return sequences.complete_scroll(t, ["user_id"], ["event_id"], "off", reach=140)


@query("""WITH r AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, max(v) FILTER (k = 1) AS best, max(v) FILTER (k = 2) AS second, coalesce(max(v) FILTER (k = 1) - max(v) FILTER (k = 2) >= 50000, true) AS clear FROM r WHERE k <= 2 GROUP BY 1""")
def w_top2_clear_winner(spark, d):
    r = table(spark, d, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("k <= 2")
    one, two = F.max(F.when(F.col("k") == 1, F.col("o_totalprice"))), F.max(F.when(F.col("k") == 2, F.col("o_totalprice")))
    return r.groupBy("o_custkey").agg(one.alias("best"), two.alias("second"), F.coalesce(one - two >= 50000, F.lit(True)).alias("clear"))


@query("""SELECT user_id, max(gap) AS longest FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events WHERE event_type = 'purchase') GROUP BY 1""")
def w_gap_longest(spark, d):
    ev = table(spark, d, "events").where("event_type = 'purchase'").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("user_id").orderBy("at", "event_id"))
    return ev.withColumn("gap", gap).groupBy("user_id").agg(F.max("gap").alias("longest"))


@query("""SELECT c_mktsegment, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS latest FROM customer GROUP BY 1""")
def w_ovr_latest(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("latest"))


@query("""SELECT p_name AS text, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, text LIMIT 10""")
def o_topn_texts(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_name").alias("text")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "text").limit(10)


EDGES = [0, 5, 10, 15, 20, 30, 50, 100]


@query("""WITH b AS (SELECT value AS v, len(list_filter([0, 5, 10, 15, 20, 30, 50, 100], lambda e: value >= e)) AS k FROM events) SELECT k AS bin, CASE k WHEN 0 THEN '< 0' WHEN 8 THEN '>= 100' ELSE [0, 5, 10, 15, 20, 30, 50, 100][k] || ' - ' || [0, 5, 10, 15, 20, 30, 50, 100][k + 1] END AS label, count(*) AS n, min(v) AS lo, round(avg(v), 6) AS mean, max(v) AS hi FROM b GROUP BY 1, 2""")
def a_hgd_histogram(spark, d):
    return evaluate.histogram(table(spark, d, "events"), "value", EDGES)


@query("""WITH n AS (SELECT o_custkey AS capture_id, o_orderstatus AS g, count(*) AS parsed, CASE WHEN max(o_orderpriority) = '1-URGENT' THEN NULL ELSE count(*) + (CASE WHEN min(o_custkey) % 4 = 0 THEN 1 ELSE 0 END) END AS expected FROM orders GROUP BY o_custkey, o_orderstatus), p AS (SELECT capture_id, bool_and(expected IS NOT NULL AND parsed = expected) AS ok, CAST(sum(parsed) AS BIGINT) AS parsed FROM n GROUP BY 1) SELECT c_custkey AS capture_id, coalesce(parsed, 0) AS parsed, CASE WHEN coalesce(ok, false) AND (c_custkey % 2 = 0 OR parsed = 10 + c_custkey % 5) THEN 'complete' ELSE 'partial' END AS status FROM customer LEFT JOIN p ON capture_id = c_custkey""")
def er_rec_reconcile(spark, d):
    o = table(spark, d, "orders")
    n = o.groupBy(F.col("o_custkey").alias("capture_id"), "o_orderstatus").agg(F.count("*").alias("parsed"), F.max("o_orderpriority").alias("p"))
    groups = n.withColumn("expected", F.when(F.col("p") != "1-URGENT", F.col("parsed") + F.when(F.col("capture_id") % 4 == 0, 1).otherwise(0)))
    stated = F.when(F.col("c_custkey") % 2 == 1, 10 + F.col("c_custkey") % 5)  # every other capture states its count
    totals = table(spark, d, "customer").select(F.col("c_custkey").alias("capture_id"), stated.alias("stated"))
    return resolve.reconcile(groups, totals)


@query("""SELECT n_nationkey AS capture_id, c_custkey AS member_id, 0.0::DOUBLE AS value, 0.9::DOUBLE AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (0, 2) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def er_zero_inferred(spark, d):
    members = table(spark, d, "customer").select(F.col("c_nationkey").alias("capture_id"), F.col("c_custkey").alias("member_id"))
    assigned = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("member_id")).join(members, "member_id")
    captures = table(spark, d, "nation").select(F.col("n_nationkey").alias("capture_id"), F.when(F.col("n_regionkey") == 1, "partial").otherwise("complete").alias("status"), F.when(F.col("n_regionkey") == 3, 1).otherwise(0).alias("unidentified"), F.when(F.col("n_regionkey") == 4, 0).otherwise(1).alias("parsed"))
    return resolve.inferred_zeros(members, assigned, captures)


EDGES_SQL = "e AS (SELECT n_nationkey AS a, (n_nationkey * 2 + 1) % 25 AS b, n_nationkey AS n FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25, 100 + n_nationkey FROM nation)"


@query(f"""WITH RECURSIVE {EDGES_SQL}, walk AS (SELECT 0 AS node, 0 AS hops, [0] AS path, CAST([] AS INTEGER[]) AS via UNION ALL SELECT e.b, hops + 1, path || [e.b], via || [e.n] FROM walk JOIN e ON e.a = node WHERE hops < 8 AND NOT list_contains(path, e.b)), best AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hops, via) AS k FROM walk) SELECT node, hops, array_to_string(path, '>') AS path FROM best WHERE k = 1""")
def g_bfs_hops(spark, d):
    """Shortest paths from node 0; of equal ones that of the earlier edges."""
    return graphs.shortest_paths(_edges(spark, d), 0).select("node", "hops", F.array_join("path", ">").alias("path"))


@query(f"""WITH {EDGES_SQL} SELECT n, CASE WHEN b > 20 THEN 'to' END AS fault FROM e WHERE b > 20 UNION ALL SELECT n, 'from' FROM e WHERE a > 20 UNION ALL SELECT n, 'anchor' FROM e WHERE n % 9 = 0""")
def g_val_bad_edges(spark, d):
    """Edges whose screens or tap anchors aren't there: screens 0 to 20, anchors of other than every ninth edge."""
    edges = _edges(spark, d).withColumn("anchor", F.col("n"))
    nodes = table(spark, d, "nation").where("n_nationkey <= 20").select(F.col("n_nationkey").alias("node"))
    return graphs.bad_edges(edges, nodes, edges.where("n % 9 <> 0").select("anchor")).select("n", "fault")


def _edges(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("a"))
    return n.select("a", ((F.col("a") * 2 + 1) % 25).alias("b"), F.col("a").alias("n")).union(n.select("a", (F.col("a") + 7) % 25, F.col("a") + 100))


# metrics


@query("""SELECT o_custkey AS member_id, strftime(o_orderdate, '%G-W%V') AS period_key, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY ALL""")
def m_wk_weekly(spark, d):
    return metrics.weekly(table(spark, d, "orders").withColumnRenamed("o_custkey", "member_id"), "member_id", "o_orderdate", "o_totalprice", parse.period_key("o_orderdate"))


@query("""SELECT user_id, count(DISTINCT CASE WHEN value >= 50 THEN CAST(ts AS DATE) END) AS days_passed, round(count(DISTINCT CASE WHEN value >= 50 THEN CAST(ts AS DATE) END) / (SELECT date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 FROM events), 6) AS share FROM events GROUP BY 1""")
def m_vsc_share_of_days(spark, d):
    return metrics.share_of_days(table(spark, d, "events").withColumn("day", F.to_date("ts")), "user_id", "day", F.col("value") >= 50)


@query("""WITH t AS (SELECT o_custkey AS member, c_nationkey AS g, year(o_orderdate) AS period, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), dl AS (SELECT *, round(total - lag(total) OVER (PARTITION BY member ORDER BY period), 2) AS delta FROM t), m AS (SELECT g, period, round(quantile_cont(delta, 0.5), 4) AS median_delta FROM dl GROUP BY ALL) SELECT member, g, CAST(period AS INTEGER) AS period, total, delta, median_delta, round(delta - median_delta, 4) AS versus_group FROM dl JOIN m USING (g, period)""")
def m_pwr_growth(spark, d):
    t = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_custkey").alias("member"), F.col("c_nationkey").alias("g"), F.year("o_orderdate").alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return metrics.growth(t, "member", "g", "period", "total")


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS g FROM d), r AS (SELECT user_id, g, count(*) AS length, max(day) AS last FROM i GROUP BY ALL) SELECT user_id, max(length) AS longest, arg_max(length, last) AS current, strftime(max(last), '%Y-%m-%d') AS last_day FROM r GROUP BY 1""")
def m_stk_streaks(spark, d):
    days = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    return metrics.streaks(days, "user_id", "day").withColumn("last_day", F.date_format("last_day", "yyyy-MM-dd"))


@query("""WITH l AS (SELECT o_custkey, date_diff('day', CAST(max(o_orderdate) AS DATE), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) AS days FROM orders GROUP BY 1) SELECT o_custkey, CAST(days AS INTEGER) AS days, CASE WHEN days >= 21 THEN 3 WHEN days >= 14 THEN 2 WHEN days >= 7 THEN 1 ELSE 0 END AS tier FROM l""")
def m_ina_inactivity(spark, d):
    o = table(spark, d, "orders")
    end = o.agg(F.to_date(F.max("o_orderdate")).alias("end"))
    last = o.groupBy("o_custkey").agg(F.to_date(F.max("o_orderdate")).alias("last")).join(F.broadcast(end))
    return metrics.inactivity(last.select("o_custkey", F.datediff("end", "last").alias("days")), "days")


COMPOSITE = "SELECT c_custkey, c_nationkey, c_acctbal, n, round(0.5 * n + 0.001 * c_acctbal, 6) AS composite FROM (SELECT c_custkey, c_nationkey, c_acctbal, CAST(count(o_orderkey) AS DOUBLE) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)"


def _composite(spark, d):
    c = table(spark, d, "customer")
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("n"))
    both = c.join(n, "c_custkey", "left").select("c_custkey", "c_nationkey", "c_acctbal", F.coalesce("n", F.lit(0.0)).alias("n"))
    return metrics.composite(both, {"n": 0.5, "c_acctbal": 0.001})


@query(COMPOSITE)
def m_cmp_composite(spark, d):
    return _composite(spark, d)


@query(f"""WITH c AS ({COMPOSITE}), q AS (SELECT c_nationkey, quantile_cont(composite, 0.1) AS cut FROM c GROUP BY 1) SELECT c.* FROM c JOIN q USING (c_nationkey) WHERE composite <= cut""")
def m_car_lowest_decile(spark, d):
    return metrics.lowest_decile(_composite(spark, d), "c_nationkey", "composite", [F.desc("c_acctbal"), "c_custkey"])


@query("""SELECT user_id, format('{} has been away for {} events', user_id, count(*)) AS message FROM events WHERE event_type = 'error' GROUP BY 1""")
def m_msg_messages(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.format_string("%d has been away for %d events", "user_id", "n").alias("message"))


@query("""SELECT event_type, round(regr_slope(value, epoch(ts) / 86400.0), 6) AS slope, regr_count(value, epoch(ts)) AS n FROM events GROUP BY 1""")
def m_dft_drift(spark, d):
    ev = table(spark, d, "events").withColumn("day", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 86400.0)
    return ev.groupBy("event_type").agg(F.round(F.regr_slope("value", "day"), 6).alias("slope"), F.regr_count("value", "day").alias("n"))
