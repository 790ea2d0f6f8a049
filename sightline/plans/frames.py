"""Labelled frames over the driver's documents: a text is a frame's bytes, a source its label."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.plans.base import query
from sightline.sources import corpus
from sightline.sources.tables import table


def _frames(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.sha2("text", 256).alias("hash"), F.concat(F.lit("l_"), F.lower("lang")).alias("label"), "n_chars", "source")


@query("""WITH f AS (SELECT doc_id, sha256(text) AS hash, 'l_' || lower(lang) AS label FROM documents), o AS (SELECT hash, min(label) AS label FROM f WHERE doc_id % 2 = 0 GROUP BY 1), n AS (SELECT hash, arg_min(label, doc_id) AS label FROM f WHERE doc_id % 2 = 1 GROUP BY 1) SELECT coalesce(o.hash, n.hash) AS hash, coalesce(o.label, n.label) AS label, o.hash IS NULL AS added FROM o FULL JOIN n ON o.hash = n.hash""")
def s_add_first_label(spark, d):
    f = _frames(spark, d)
    old = f.where("doc_id % 2 = 0").groupBy("hash").agg(F.min("label").alias("label"))
    return corpus.add_frames(old, f.where("doc_id % 2 = 1"), "doc_id")


@query("""WITH f AS (SELECT sha256(text) AS hash, min('l_' || lower(lang)) AS label FROM documents GROUP BY 1), m AS (SELECT sha256(text) AS hash, max('s_' || lower(source)) AS label FROM documents WHERE n_chars > 1000 GROUP BY 1) SELECT f.hash, coalesce(m.label, f.label) AS label FROM f LEFT JOIN m ON f.hash = m.hash""")
def s_rel_relabelled(spark, d):
    f = _frames(spark, d)
    moves = f.where("n_chars > 1000").groupBy("hash").agg(F.max(F.concat(F.lit("s_"), F.lower("source"))).alias("label"))
    return corpus.relabel(f.groupBy("hash").agg(F.min("label").alias("label")), moves)


@query("""WITH f AS (SELECT sha256(text) AS hash, min('l_' || lower(lang)) AS label, min(doc_id) AS device, min(n_chars) AS width FROM documents GROUP BY 1) SELECT hash, label, CASE WHEN device % 3 = 0 THEN device + 1000000 WHEN device % 2 = 0 THEN device END AS device, CASE WHEN device % 3 = 0 THEN NULL WHEN device % 2 = 0 THEN width END AS width FROM f""")
def j_meta_reindexed(spark, d):
    """S-IDX and J-META: half of the frames have an entry; a third get a new one, without a width."""
    f = _frames(spark, d).groupBy("hash").agg(F.min("label").alias("label"), F.min("doc_id").alias("device"), F.min("n_chars").alias("width"))
    metas = f.where("device % 3 = 0").select("hash", (F.col("device") + 1_000_000).alias("device"), F.lit(None).cast("long").alias("width"))
    return corpus.reindex(f.where("device % 2 = 0"), f, metas, ["device", "width"])


@query("""SELECT DISTINCT sha256(text) AS hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)""")
def s_pul_to_fetch(spark, d):
    f = _frames(spark, d)
    return corpus.to_fetch(f, f.where("doc_id % 3 = 0")).select("hash")


@query("""WITH n AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0), s AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 3 = 0) SELECT count(*) FILTER (s.h IS NULL) AS pushed, count(s.h) AS present FROM n LEFT JOIN s ON n.h = s.h""")
def s_psh_pushed(spark, d):
    f = _frames(spark, d).select("hash", "doc_id")
    stored = f.where("doc_id % 3 = 0").select("hash", F.lit(True).alias("there")).distinct()
    return f.where("doc_id % 3 <> 0").select("hash").distinct().join(stored, "hash", "left").agg(F.count_if(F.col("there").isNull()).alias("pushed"), F.count("there").alias("present"))


@query("""WITH f AS (SELECT doc_id, sha256(text) AS hash, source FROM documents), o AS (SELECT DISTINCT hash FROM f WHERE doc_id % 4 = 0), b AS (SELECT f.source AS burst, o.hash IS NOT NULL OR row_number() OVER (PARTITION BY f.hash ORDER BY doc_id) > 1 AS again FROM f LEFT JOIN o ON f.hash = o.hash WHERE doc_id % 4 <> 0) SELECT burst, count(*) FILTER (NOT again) AS captured, count(*) FILTER (again) AS recaptured FROM b GROUP BY 1""")
def s_rec_bursts(spark, d):
    f = _frames(spark, d)
    burst = f.where("doc_id % 4 <> 0").select("hash", F.col("source").alias("burst"), F.col("doc_id").alias("seq"))
    return corpus.record(burst, f.where("doc_id % 4 = 0"), "burst")


@query("""SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN '_unsorted' ELSE 'l_' || lower(lang) END AS label FROM documents WHERE n_chars % 5 <> 0""")
def s_lcf_labelled_frames(spark, d):
    f = _frames(spark, d).withColumn("label", F.when(F.col("n_chars") % 5 == 0, corpus.UNSORTED).otherwise(F.col("label")))
    return corpus.labelled(f).select("doc_id", "label")


RECTS = "SELECT p_partkey AS anchor_id, p_brand || '/' || CAST(p_partkey // 200 AS VARCHAR) AS template, (p_partkey % 17) / 20.0::DOUBLE AS x1, (p_partkey % 13) / 16.0::DOUBLE AS y1, (p_partkey % 17) / 20.0::DOUBLE + p_size / 250.0::DOUBLE AS x2, (p_partkey % 13) / 16.0::DOUBLE + p_size / 300.0::DOUBLE AS y2, p_size - 1 AS reference_height, p_retailprice / 1500.0::DOUBLE AS threshold FROM part"


def _anchors(spark, d):
    p = table(spark, d, "part")
    x, y = (F.col("p_partkey") % 17) / 20.0, (F.col("p_partkey") % 13) / 16.0
    name = F.concat_ws("/", "p_brand", F.floor(F.col("p_partkey") / 200).cast("string"))
    return p.select(F.col("p_partkey").alias("anchor_id"), name.alias("template"), x.alias("x1"), y.alias("y1"), (x + F.col("p_size") / 250.0).alias("x2"), (y + F.col("p_size") / 300.0).alias("y2"), (F.col("p_size") - 1).alias("reference_height"), (F.col("p_retailprice") / 1500.0).alias("threshold"))


MEET = "a.template = b.template AND a.anchor_id < b.anchor_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2"


@query(f"""WITH r AS ({RECTS}) SELECT a.anchor_id AS a, b.anchor_id AS b FROM r a JOIN r b ON {MEET}""")
def j_ovl_rectangles(spark, d):
    """Anchors of one template that overlap, met in the cells of a grid."""
    return corpus.overlaps(_anchors(spark, d), "anchor_id", ["template"])


@query(f"""WITH r AS ({RECTS}), g AS (SELECT *, x1 >= 0 AND y1 >= 0 AND x2 <= 1 AND y2 <= 1 AND x1 < x2 AND y1 < y2 AS ok FROM r), o AS (SELECT a.anchor_id AS a, b.anchor_id AS b FROM g a JOIN g b ON {MEET} WHERE a.ok AND b.ok) SELECT anchor_id, 'reference_height' AS fault FROM g WHERE NOT reference_height > 0 UNION ALL SELECT anchor_id, 'rect' FROM g WHERE NOT ok UNION ALL SELECT anchor_id, 'threshold' FROM g WHERE NOT threshold BETWEEN 0 AND 1 UNION ALL (SELECT a, 'overlap' FROM o UNION SELECT b, 'overlap' FROM o)""")
def s_man_manifest_faults(spark, d):
    return corpus.manifest_faults(_anchors(spark, d))


@query("""SELECT * FROM (SELECT 'positive' AS rule, count(*) FILTER (NOT c_acctbal > 0) AS n FROM customer UNION ALL SELECT 'named', count(*) FILTER (NOT length(c_name) > 0) FROM customer UNION ALL SELECT 'segment', count(*) FILTER (NOT c_mktsegment IN ('BUILDING', 'MACHINERY')) FROM customer) WHERE n > 0""")
def s_fix_shape_faults(spark, d):
    rules = {"positive": F.col("c_acctbal") > 0, "named": F.length("c_name") > 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")}
    return corpus.shape_faults(table(spark, d, "customer"), rules)


@query("""SELECT source, list_sort(list_filter(['de', 'en', 'es', 'fr', 'pl'], lambda x: NOT list_contains(list(DISTINCT lang), x)))[1] AS missing FROM documents GROUP BY 1""")
def s_lng_missing_languages(spark, d):
    """S-LNG and U-DIF: of the wanted languages, the first that a source doesn't have."""
    wanted = F.array(*map(F.lit, ("de", "en", "es", "fr", "pl")))
    return table(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("have")).select("source", F.get(F.sort_array(F.array_except(wanted, "have")), F.lit(0)).alias("missing"))
