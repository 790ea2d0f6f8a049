"""Header cards, and what is written, checked, published and read back, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import headers
from sightline.plans.base import query
from sightline.sources import index, published
from sightline.sources.tables import table
from sightline.streaming.runner import scratch

HEIGHT, TOP, BOTTOM, LEAST, GAP, HALF = 1600, 440, 1488, 30, 8.0, 24
#: A frame is an order, its lines the bands; each line is a badge too, somewhere else. The order's priority is the sticky header, the lowest one can't be read.
CARDS_SQL = f"""WITH fr AS (SELECT o_orderkey AS frame, o_custkey AS capture, CASE WHEN o_orderpriority NOT LIKE '5%' THEN 'R' || left(o_orderpriority, 1) END AS rank FROM orders),
b AS (SELECT l_orderkey AS frame, l_linenumber AS n, 440 + l_partkey * 7 % 900 AS lo, 440 + l_partkey * 7 % 900 + 100 AS hi FROM lineitem),
bd AS (SELECT l_orderkey AS frame, 440 + l_suppkey * 131 % 1040 AS y, 'R' || (1 + (l_partkey + l_linenumber) % 4) AS rank, CAST(l_quantity AS DOUBLE) AS score FROM lineitem),
e AS (SELECT frame, lo, hi FROM b UNION ALL SELECT frame, {TOP}, {TOP} FROM fr),
g AS (SELECT frame, greatest(coalesce(max(hi) OVER (PARTITION BY frame ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {TOP}), {TOP}) AS start, lo AS stop FROM e UNION ALL SELECT frame, greatest(max(hi), {TOP}), {BOTTOM} FROM e GROUP BY 1),
s AS (SELECT g.frame, start, rank, max(score) AS score, arg_min(y, (-score, y)) AS y FROM g JOIN bd ON g.frame = bd.frame AND y >= start AND y < stop WHERE stop - start >= {LEAST} GROUP BY ALL),
t AS (SELECT *, row_number() OVER w AS k, score - coalesce(lead(score) OVER w, 0) AS ahead FROM s WINDOW w AS (PARTITION BY frame, start ORDER BY score DESC, -y DESC, rank DESC)),
c AS (SELECT frame, y - {HALF} AS y0, rank, score, ahead AS lead FROM t WHERE k = 1 AND ahead >= {GAP} AND y - {HALF} >= 0 AND y + {HALF} <= {HEIGHT}),
ow AS (SELECT b.frame, n, fr.capture, CASE WHEN fr.rank IS NOT NULL THEN coalesce((SELECT arg_max(c.rank, (c.y0, c.rank)) FROM c WHERE c.frame = b.frame AND c.y0 <= b.lo), fr.rank) END AS owner FROM b JOIN fr ON b.frame = fr.frame)"""


def _cards(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    sticky = o.select(F.col("o_orderkey").alias("frame"), F.col("o_custkey").alias("capture"), F.when(~F.col("o_orderpriority").startswith("5"), F.concat(F.lit("R"), F.substring("o_orderpriority", 1, 1))).alias("rank"))
    lo = 440 + F.col("l_partkey") * 7 % 900
    bands = li.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("n"), lo.alias("lo"), (lo + 100).alias("hi"))
    rank = F.concat(F.lit("R"), (1 + (F.col("l_partkey") + F.col("l_linenumber")) % 4).cast("string"))
    badges = li.select(F.col("l_orderkey").alias("frame"), (440 + F.col("l_suppkey") * 131 % 1040).alias("y"), rank.alias("rank"), F.col("l_quantity").cast("double").alias("score"))
    return sticky, bands, headers.cards(sticky, bands, badges, ["frame"], TOP, BOTTOM, LEAST, GAP, HALF, HEIGHT)


@query(f"{CARDS_SQL} SELECT * FROM c")
def i_hdr_cards(spark, d):
    """I-HDR: the cards in the space that bands leave free."""
    return _cards(spark, d)[2]


@query(f"{CARDS_SQL} SELECT frame, n, owner FROM ow")
def i_hdr_owners(spark, d):
    """I-HDR: each band's header, the last card above it or the sticky one."""
    sticky, bands, found = _cards(spark, d)
    return headers.owned(bands, found, sticky, ["frame"]).select("frame", "n", "owner")


@query(f"""{CARDS_SQL}, sh AS (SELECT capture, rank, count(*) AS frames FROM (SELECT c.frame, capture, c.rank FROM c JOIN fr ON c.frame = fr.frame UNION SELECT frame, capture, rank FROM fr WHERE rank IS NOT NULL) GROUP BY ALL) SELECT sh.capture, sh.rank, frames, count(owner) AS bands FROM sh LEFT JOIN ow ON ow.capture = sh.capture AND owner = sh.rank GROUP BY ALL""")
def i_cnt_header_tallies(spark, d):
    """Headers of a capture with the rows that are theirs, those without rows too."""
    sticky, bands, found = _cards(spark, d)
    of = sticky.select("frame", "capture")
    owners = headers.owned(bands, found, sticky, ["frame"]).join(of, "frame")
    return headers.tallies(owners, found.join(of, "frame"), sticky, ["frame", "capture"], "capture")


@query("""SELECT lower(replace(p_brand, '#', '_')) AS screen, 'a' || p_partkey AS anchor_id, CASE WHEN p_partkey % 3 = 0 THEN p_size / 100.0::DOUBLE ELSE p_size / 50.0::DOUBLE END AS threshold FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""")
def s_mwr_published_anchors(spark, d):
    """S-MWR: anchors are published, then some with faults are refused, then others added and replaced."""
    x, y = F.col("p_partkey") % 17 / 20.0, F.col("p_partkey") % 13 / 16.0
    parts = table(spark, d, "part").select("p_partkey", F.lower(F.translate("p_brand", "#", "_")).alias("screen"), F.concat(F.lit("a"), "p_partkey").alias("anchor_id"), x.alias("x1"), y.alias("y1"), (x + F.col("p_size") / 250.0).alias("x2"), (y + (F.col("p_size") + 4) / 400.0).alias("y2"), (F.col("p_size") / 50.0).alias("threshold"), F.lit(1600).alias("reference_height"), (F.col("p_size") * 4).alias("template_height"), F.col("p_retailprice").cast("double").alias("variance"))
    path = scratch(spark, "anchors")
    some = lambda rule, **by: parts.where(rule).withColumns(by).drop("p_partkey")
    published.write_anchors(spark, path, some("p_partkey % 2 = 0"))
    try:
        published.write_anchors(spark, path, some("p_partkey % 5 = 0", threshold=F.col("threshold") + 1))
    except published.Refused:
        pass
    published.write_anchors(spark, path, some("p_partkey % 3 = 0", threshold=F.col("threshold") / 2))
    return published.read(spark, path, "anchors").select("screen", "anchor_id", "threshold")


@query("""SELECT o_orderkey AS capture_id, l_linenumber AS seq FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'O'""")
def o_rcp_published_frames(spark, d):
    """O-RCP: captures by status in batches, one of them written twice; of open ones the frames are written, but not the headers, so nothing of them is read."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("capture_id"), F.col("o_orderstatus").alias("status"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("capture_id"), F.col("l_linenumber").alias("seq"))
    path = scratch(spark, "captures")
    frames_of = lambda heads: li.join(heads.select("capture_id"), "capture_id", "left_semi")
    for batch, status in ((0, "F"), (1, "P"), (1, "P")):
        heads = o.where(F.col("status") == status)
        published.record_captures(heads, frames_of(heads), path, batch)
    frames_of(o.where("status = 'O'")).write.parquet(f"{path}/frames/{2:012d}")
    return published.recorded(spark, path, o.schema, li.schema)[1]


@query("""SELECT sha256(text) AS hash, min('l_' || lower(lang)) AS label, CAST(nullif(min(n_chars), 0) AS INTEGER) AS width, CASE WHEN min(doc_id) % 3 <> 0 THEN min(source) || ' "' || min(lang) || chr(10) || '- hash: x' END AS device, min(doc_id) * 1001 + 5 AS captured FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def s_idx_round_trip(spark, d):
    """S-IDX: the index of all texts written as YAML and read back."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min(F.concat(F.lit("l_"), F.lower("lang"))).alias("label"), F.min("n_chars").cast("int").alias("width"), F.min("doc_id").alias("id"), F.min("source").alias("s"), F.min("lang").alias("l"))
    device = F.when(F.col("id") % 3 != 0, F.concat("s", F.lit(' "'), "l", F.lit("\n- hash: x")))
    rows = docs.select("hash", "label", "width", F.lit(None).cast("int").alias("height"), F.timestamp_seconds(F.col("id") * 1001 + 5).alias("captured_at"), device.alias("device"), F.lit("1.20").alias("game_version"))
    path = scratch(spark, "index")
    index.write_index(rows, path)
    back = index.read_index(spark, path).where("height IS NULL AND game_version = '1.20'")
    return back.select("hash", "label", "width", "device", F.unix_seconds("captured_at").alias("captured"))
