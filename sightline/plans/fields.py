"""Column functions that the other modules don't show at work, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import names, parse
from sightline.operators import facts
from sightline.plans.base import query
from sightline.sources import corpus
from sightline.sources.tables import table


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey * 1500 WHEN 1 THEN c_custkey * 2000000 WHEN 2 THEN c_custkey ELSE NULL END AS n FROM customer""")
def f_abb_numbers(spark, d):
    """1.5K for each thousand and a half, whole millions, plain numbers, and what is none."""
    k = F.col("c_custkey")
    shown = F.when(k % 4 == 0, F.format_string("%.1fK", k * 1.5)).when(k % 4 == 1, F.format_string("%dM", k * 2)).when(k % 4 == 2, k.cast("string")).otherwise(F.format_string("%dX", k))
    return table(spark, d, "customer").select("c_custkey", parse.abbreviated(shown).alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey AS INTEGER) END AS members, CASE WHEN c_custkey % 2 = 0 THEN '1.' || c_custkey ELSE '' END AS version, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey AS VARCHAR) END, '?') AS label FROM customer""")
def f_amc_counts_and_versions(spark, d):
    """F-AMC, F-VER and F-EXP."""
    k = F.col("c_custkey")
    line = F.when(k % 3 != 0, F.format_string("Members: %d / %d", k, k + 5)).otherwise("Members: none")
    dump = F.when(k % 2 == 0, F.format_string("  versionCode=7\n    versionName=1.%d targetSdk=33", k)).otherwise("versionCode=7")
    return table(spark, d, "customer").select("c_custkey", parse.member_count(line).alias("members"), parse.version_name(dump).alias("version"), parse.expected_label(parse.member_count(line)).alias("label"))


@query("""SELECT o_orderkey, regexp_replace(o_orderpriority, '[^0-9,]+$', '') AS trimmed FROM orders""")
def f_trm_artifacts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", parse.without_artifact("o_orderpriority").alias("trimmed"))


@query("""SELECT n_regionkey, string_agg(CASE WHEN n_nationkey % 3 <> 0 THEN n_name END, '|' ORDER BY n_name) AS ready FROM nation GROUP BY 1""")
def f_adb_listed_devices(spark, d):
    state = F.when(F.col("n_nationkey") % 3 != 0, "device").otherwise("offline")
    line = F.concat("n_name", F.lit("\t"), state)
    text = F.concat(F.lit("List of devices attached\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"))
    listed = table(spark, d, "nation").groupBy("n_regionkey").agg(text.alias("text"))
    return listed.select("n_regionkey", F.array_join(parse.listed_devices("text"), "|").alias("ready"))


@query("""SELECT p_partkey, round(0.1, 6) AS x1, round((p_size + 0.25 * 40) / 1600.0, 6) AS y1, round(0.6, 6) AS x2, round((p_size + 0.75 * 40) / 1600.0, 6) AS y2 FROM part""")
def p_fr_field_rects(spark, d):
    p = table(spark, d, "part")
    r = parse.field_rect("p_size", F.col("p_size") + 40, F.lit(1600), 0.1, 0.6, 0.25, 0.75)
    return p.select("p_partkey", r.alias("r")).select("p_partkey", *(F.round(f"r.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("""WITH r AS (SELECT p_partkey, p_size / 50.0 AS x1, (p_size % 7) / 7.0 AS y1, p_size / 40.0 AS x2, (p_size % 11) / 10.0 AS y2 FROM part) SELECT p_partkey, x1 >= 0 AND y1 >= 0 AND x2 <= 1 AND y2 <= 1 AND x1 < x2 AND y1 < y2 AS valid, round(greatest(0, least(1, x1 - 0.1)), 6)::DOUBLE AS left_edge, round(greatest(0, least(1, x2 + 0.1)), 6)::DOUBLE AS right_edge FROM r""")
def p_rect_valid_and_padded(spark, d):
    """P-RECT and P-PAD."""
    s = F.col("p_size")
    r = table(spark, d, "part").select("p_partkey", (s / 50.0).alias("x1"), (s % 7 / 7.0).alias("y1"), (s / 40.0).alias("x2"), (s % 11 / 10.0).alias("y2"))
    out = parse.padded("x1", "y1", "x2", "y2", 0.1)
    return r.select("p_partkey", parse.valid_rect("x1", "y1", "x2", "y2").alias("valid"), F.round(out["x1"], 6).alias("left_edge"), F.round(out["x2"], 6).alias("right_edge"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, least(1 - l_discount, 1 - l_tax) >= 0.95 AS written, 1 - l_tax >= 0.96 AS accepted FROM lineitem""")
def p_gate_written(spark, d):
    """P-GATE and P-MIN."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", facts.gate(1 - F.col("l_discount"), 1 - F.col("l_tax"), 0.95).alias("written"), (1 - F.col("l_tax") >= 0.96).alias("accepted"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment LIKE 'B%' THEN 'roster' WHEN c_mktsegment LIKE 'M%' THEN 'vs_ranking' ELSE 'error' END AS route FROM customer""")
def p_route_captures(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment").startswith("B"), "roster").when(F.col("c_mktsegment").startswith("M"), "vs_ranking").otherwise("error").alias("route"))


@query("""SELECT s_suppkey, 'supplier' || CAST(lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS VARCHAR) AS normal, 'supplier ' || CAST(lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS VARCHAR) AS tokens, 'supplier' || CAST(lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS VARCHAR) AS folded FROM supplier""")
def f_nrm_normal_names(spark, d):
    """F-NRM, F-NTK and F-HMG: ornaments go, white space goes or is one blank, letters that look alike become Latin."""
    s = table(spark, d, "supplier").select("s_suppkey", F.replace("s_name", F.lit("#"), F.lit("  ")).alias("n"))
    ornate, foreign = F.concat(F.lit("★"), "n", F.lit(" ♥")), F.translate("n", "eiop", "еіор")
    return s.select("s_suppkey", names.normalised(ornate).alias("normal"), names.normalised_tokens("n").alias("tokens"), names.normalised(foreign).alias("folded"))


@query("""SELECT o_orderkey, '{"label":"' || o_orderstatus || '","score":' || CAST(o_custkey % 100 AS VARCHAR) || ',"hit":' || CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS report FROM orders""")
def s_json_reports(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("label"), (F.col("o_custkey") % 100).alias("score"), (F.col("o_custkey") % 2 == 0).alias("hit"))).alias("report"))


@query("""SELECT format('{:<10}{:>8d} {:>6.1f}%', o_orderstatus, count(*), 100.0 * count(*) / (SELECT count(*) FROM orders)) AS line FROM orders GROUP BY o_orderstatus""")
def s_txt_report_lines(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    every = o.agg(F.sum("n").alias("all"))
    return o.join(F.broadcast(every)).select(F.format_string("%-10s%8d %6.1f%%", "o_orderstatus", "n", 100.0 * F.col("n") / F.col("all")).alias("line"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'data/' || lang ELSE 's3a://' || lang END AS root FROM documents""")
def s_sel_roots(spark, d):
    """The address of a store by its backend, for every language and for none."""
    even = F.col("doc_id") % 2 == 0
    place = F.when(even, F.concat(F.lit("data/"), "lang")).otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", corpus.root_column(F.when(even, "fs").otherwise("s3"), place).alias("root"))
