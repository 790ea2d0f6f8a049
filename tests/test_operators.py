import datetime
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import names, schedule
from sightline.operators import facts, graphs, imaging, ingest, resolve, sequences, store
from sightline.sources import corpus
from sightline.streaming import upserts
from tests.conftest import SF


def test_names_that_look_alike():
    assert names.distance("alban80", "albanso") == 4 and names.distance("kitten", "sitting") == 30
    assert names.token_set_ratio("AA91AA", "AASIAA") >= names.ACCEPT
    assert names.token_set_ratio("Delta", "Omega") < names.REVIEW
    assert names.token_set_ratio("", "x") == 0 and names.token_set_ratio("★★", "x") == 0
    assert names.normal("Ｆｕｌｌ Ｗíde") == "fullwide" and names.normal("Аlех") == "alex"
    assert names.normal_tokens("  Big  Bad Wolf ") == ["big", "bad", "wolf"]


def assigned(rows):
    m, s, p = resolve.assign(np.array(rows))
    return list(zip(m.tolist(), s.tolist(), p.tolist(), strict=True))


def test_assignment_rules():
    assert assigned([[95, 95]]) == [(-1, 0, 0)]  # a tie is refused
    assert assigned([[95, 94]]) == [(0, 95, 1)]  # a point decides
    assert assigned([[100, 70], [96, 61]]) == [(0, 100, 1), (-1, 0, 3)]  # a duplicate takes no free member
    assert assigned([[65]]) == [(0, 65, 2)]  # alone, the margin is void
    assert assigned([[80, 65]]) == [(-1, 0, 0)] and assigned([[85, 65]]) == [(0, 85, 2)]
    assert assigned([[98, 98], [99, 0]]) == [(1, 98, 1), (0, 99, 1)]  # a claim frees a tie


def claims(scores, floor=60, margin=20):
    """The same by the definition, one claim at a time over plain lists."""
    out, rows, free = {r: (-1, 0, 0) for r in range(len(scores))}, list(range(len(scores))), set(range(len(scores[0])))
    for phase, least, lead in ((1, 92, 1), (2, floor, margin)):
        while True:
            tries = []
            for r in rows:
                ranked = sorted(((scores[r][m], -m) for m in free), reverse=True)
                if ranked and ranked[0][0] >= least and (len(ranked) == 1 or ranked[0][0] - ranked[1][0] >= lead):
                    tries.append((ranked[0][0], -r, -ranked[0][1]))
            if not tries:
                break
            score, r, m = max(tries)
            out[-r] = m, score, phase
            rows.remove(-r)
            free.discard(m)
        if phase == 1:
            for r in list(rows):
                if any(scores[r][m] >= 92 for m in set(range(len(scores[0]))) - free):
                    out[r] = -1, 0, 3
                    rows.remove(r)
    return [out[r] for r in range(len(scores))]


def test_assignment_equals_single_claims():
    r = random.Random(4)
    for _ in range(300):
        m = [[r.choice((0, 30, 55, 61, 70, 85, 90, 92, 93, 96, 100)) for _ in range(r.randint(1, 5))] for _ in range(1)]
        m += [[r.choice((0, 30, 55, 61, 70, 85, 90, 92, 93, 96, 100)) for _ in m[0]] for _ in range(r.randint(0, 5))]
        assert assigned(m) == claims(m), m


def test_roster_creation():
    got = resolve.roster_rows([(0, "Alpha", 0.9), (1, "Alpha", 0.9), (2, " ", 0.9), (3, "Omega", 0.2), (4, "Zulu", 0.9), (5, "Quebec", 0.9)], {}, 2)
    assert [g[1] for g in got] == ["created", "matched", "unreadable_name", "low_confidence_name", "created", "no_confident_match_group_full"]
    assert resolve.roster_rows([(0, "Alpha", 0.9)], {}, None)[0][1] == "no_confident_match_group_count_unknown"


def test_a_created_member_does_not_win_a_tie():
    got = resolve.roster_rows([(0, "Abcdefgh", 0.9), (1, "Zzzz", 0.9), (2, "Abcdefgh", 0.9)], {7: "Abcdefgh"}, 5)
    assert got == [(0, "matched", 7), (1, "created", -1), (2, "matched", 7)]


def test_attribution(spark):
    rows = [(1, 95, "1,234", 0.9, 95, 0, 2**63 - 1, ""), (3, 95, "1", 0.9, 95, 0, 9, ""), (0, 80, "1", 0.9, 0, 0, 9, ""), (0, 10, "1", 0.9, 0, 0, 9, ""), (1, 95, "1,2?4", 0.9, 95, 1200, 1215, ""), (1, 95, "x?y", 0.9, 95, 0, 9, "7"), (1, 95, "zz", 0.9, 95, 0, 9, "77"), (1, 95, "50", 0.9, 95, 0, 9, ""), (1, 95, "1,000", 0.5, 95, 500, 1100, ""), (1, 95, "1,000", 0.5, 95, 0, 1100, ""), (2, 70, "5", 0.95, 70, 1, 9, ""), (1, 95, "1,2?4 pts", 0.9, 95, 1230, 1239, ""), (1, 95, "zz", 0.9, 95, 0, 9, "7 x")]
    df = spark.createDataFrame([(*r, 0.85, False) for r in rows] + [(1, 95, "zz", 0.9, 95, 0, 9, "7", 0.9, True)], "phase int, top int, text string, conf double, score int, lo long, hi long, retry string, retry_conf double, from_retry boolean")
    got = [r.a for r in resolve.attributed(df, "a", *(F.col(c) for c in df.columns)).select("a").collect()]
    assert [(a.outcome, a.value, a.reason) for a in got] == [("fact", 1234, None), ("duplicate", None, None), ("review", None, "ambiguous_name_match"), ("review", None, "no_confident_match"), ("review", None, "unparseable_points"), ("fact", 7, None), ("review", None, "unparseable_points"), ("review", None, "points_out_of_order"), ("fact", 1000, None), ("review", None, "low_confidence_points"), ("fact", 5, None), ("fact", 1234, None), ("fact", 7, None), ("review", None, "unparseable_points")]
    assert got[8].confidence == 0.8 and got[10].confidence == 0.85 and got[5].confidence == 0.85 and got[9].confidence == 0.5


def test_longest_falling_and_spacing(spark):
    assert sequences.longest_falling([9, 100, 90, 80]) == [False, True, True, True]
    assert sequences.longest_falling([5, 5, 5]) == [True] * 3 and sequences.longest_falling([]) == []
    r = random.Random(1)
    for _ in range(50):
        v = [r.randrange(8) for _ in range(8)]
        keep = [x for x, k in zip(v, sequences.longest_falling(v), strict=True) if k]
        best = max(bin(m).count("1") for m in range(256) if (s := [v[i] for i in range(8) if m >> i & 1]) == sorted(s, reverse=True))
        assert keep == sorted(keep, reverse=True) and len(keep) == best
    df = spark.createDataFrame([(1, k, float(y)) for k, y in enumerate((0, 40, 70, 110, 150))], "g int, k int, y double")
    assert [r.y for r in sequences.spaced(df, ["g"], ["k"], "y", 64).orderBy("k").collect() if r.accepted] == [0, 70, 150]


def test_upsert_equals_a_fold(spark):
    r = random.Random(2)
    rows = [(r.randrange(5), "m", "p", "s", "t", float(i), float(np.float32(r.choice((0.5, 0.8, 0.8000001, 0.9)))), i) for i in range(400)]
    state: dict = {}
    for m, *_, value, conf, i in rows:
        if m not in state:
            state[m] = (value, conf, i)
        elif np.float32(conf) > np.float32(state[m][1]):
            state[m] = (value, conf, state[m][2])
    df = spark.createDataFrame(rows, "member_id int, metric string, period_key string, source string, observed_at string, value double, confidence double, arrival int").repartition(3)
    assert {x.member_id: (x.value, x.confidence, x.fact_id) for x in facts.upsert(df).collect()} == state


def fnv(*parts):
    h = 0xCBF29CE484222325
    for byte in b"".join(p.encode() + b"\0" for p in parts):
        h = (h ^ byte) * 0x100000001B3 % 2**64
    return h


def test_hashes_and_windows(spark):
    rows = [("", "a"), ("12", "2024-03-01"), ("é日本", "x" * 40)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [int(r.h) for r in df.select(schedule.number(schedule.fnv1a(F.col("a"), F.col("b"))).alias("h")).collect()] == [fnv(*r) for r in rows]
    df = spark.sql("SELECT id AS account, timestamp'2024-03-01 00:00:00' + make_interval(0, 0, 0, 0, cast(h AS int), 0, 0) AS now FROM range(20) LATERAL VIEW explode(sequence(0, 23)) t AS h")
    for r in df.select("account", "now", schedule.offline(F.col("account"), F.col("now")).alias("o")).collect():
        want = False
        for back in (0, 1):
            h = fnv(str(r.account), (r.now - datetime.timedelta(days=back)).strftime("%Y-%m-%d"))
            start, minute = h % 1440, r.now.hour * 60 + r.now.minute + 1440 * back
            want |= start <= minute < start + 300 + h // 1440 % 121
        assert r.o == want
    got = spark.range(50).select("id", schedule.cadence_offset(F.col("id"), F.lit("t"), F.lit(5), F.lit(10**9)).alias("s")).collect()
    assert [r.s for r in got] == [int((fnv(str(r.id), "t", "5") % 40001 / 40000.0 * 0.4 - 0.2) * 1e9) for r in got]


def slow_correlation(img, t):
    """Scores of every place by the definition."""
    h, w = t.shape
    out = np.zeros((img.shape[0] - h + 1, img.shape[1] - w + 1))
    d = t - t.mean()
    for y, x in np.ndindex(out.shape):
        p = img[y : y + h, x : x + w] - img[y : y + h, x : x + w].mean()
        out[y, x] = 0 if not p.any() else (p * d).sum() / np.sqrt((p * p).sum() * (d * d).sum())
    return out


def listing(pitch, rows, height=400, top=30, broken=()):
    """A frame of bright gaps and dark rows; broken boundaries are dark too."""
    img = np.full((height, 60), 120, np.uint8)
    for k in range(rows + 1):
        if k not in broken and top + k * pitch < height:
            img[top + k * pitch] = 250
    return img


def test_image_kernels(spark):
    r = np.random.default_rng(1)
    img = r.integers(0, 256, (60, 50)).astype(np.uint8)
    assert imaging.correlate(img, img[20:30, 15:27]) == (1.0, 20, 15)
    part = r.integers(0, 256, (7, 9)).astype(np.uint8)
    want = slow_correlation(img.astype(float), part.astype(float))
    score, y, x = imaging.correlate(img, part)
    assert abs(score - want.max()) < 1e-6 and (y, x) == np.unravel_index(want.argmax(), want.shape)
    assert imaging.correlate(img, img[40:50, 5:17], (0, 0, 1, 0.5))[1] <= 20
    flat = np.full((30, 30), 9, np.uint8)
    assert imaging.correlate(flat, part)[0] == 0
    with pytest.raises(ValueError):
        imaging.correlate(img, flat[:4, :4])
    profile = np.array([100.0 if y % 13 == 5 else 20.0 for y in range(130)])
    assert imaging.phase(profile, 13) == (5, 80.0, 10) and imaging.best_pitch(profile, 12) == (13, 80.0)
    assert imaging.equalise(np.array([[10, 10], [20, 30]], np.uint8)).tolist() == [[0, 0], [127, 255]]
    assert (imaging.threshold(flat, 5, 0) == 0).all() and (imaging.threshold(flat, 5, 1) == 255).all() and imaging.resize(img, 30, 25).shape == (30, 25)
    df = spark.createDataFrame([(1, 60, 50, bytearray(img.tobytes()))], "id int, height int, width int, pixels binary")
    assert imaging.over_images(df, lambda x: {"mean": float(x.mean())}, "id", "id int, mean double").first().mean == img.mean()


def test_scroll_offsets():
    r = np.random.default_rng(3)
    page = r.integers(0, 256, (600, 60)).astype(np.uint8)
    before = page[:400]
    for d in (0, 1, 37, 120):
        assert imaging.scroll_offset(before, page[d : d + 400], (0, 0.1, 1, 0.9)) == d
    assert imaging.scroll_offset(before, r.integers(0, 256, (400, 60)).astype(np.uint8)) is None
    assert imaging.scroll_offset(np.zeros((400, 60), np.uint8), np.zeros((400, 60), np.uint8)) is None


def test_rows_are_segmented():
    full = (0, 0, 1, 1)
    assert imaging.segment_rows(listing(40, 5), full, 40) == [(30 + 40 * k, 70 + 40 * k) for k in range(5)]
    # a broken boundary parts the run; what lies beyond it is searched once more
    assert imaging.segment_rows(listing(40, 8, broken=(4,)), full, 40) == [(30 + 40 * k, 70 + 40 * k) for k in (0, 1, 2, 5, 6, 7)]
    assert imaging.segment_rows(np.full((400, 60), 120, np.uint8), full, 40) == []
    with pytest.raises(imaging.PitchMismatch):
        imaging.segment_rows(listing(50, 7), full, 40)


def test_masks_counts_and_badges():
    img = np.zeros((4, 6, 3), np.uint8)
    img[1, 2], img[2, 3] = (250, 250, 250), (250, 20, 20)
    assert (imaging.white_ink(img, 200, 10) == 0).sum() == 1 and (imaging.saturated_ink(img, 100) == 0).sum() == 1
    assert imaging.trim_to_ink(img, (0, 0, 1, 1), 100, 0.0) == (0, 0, 4 / 6, 1) and imaging.trim_to_ink(img, (0, 0, 0.3, 1), 100, 0.0) == (0, 0, 0.3, 1)
    assert imaging.preprocess(img).shape == (12, 18) and imaging.invert(np.array([[5]], np.uint8)).item() == 250
    assert imaging.agreed_total(["1", "2"], "/12") == 12 and imaging.agreed_total(["1", "2"], "13") is None and imaging.agreed_total(["12"], "12") is None
    assert imaging.clear_winner({"R1": 0.9, "R2": 0.6}) == "R1" and imaging.clear_winner({"R1": 0.9, "R2": 0.8}) is None


def test_store_lookups_and_paths(spark):
    nation = spark.read.parquet(f"{SF}/nation.parquet")
    with pytest.raises(store.NotFound):
        store.lookup(nation, F.col("n_nationkey") == 99)
    edges = spark.createDataFrame([(0, 1, 0), (1, 2, 1), (0, 3, 2), (3, 2, 3), (2, 4, 4)], "a long, b long, n long")
    paths = graphs.shortest_paths(edges, 0)
    assert graphs.path_to(paths, 4) == [0, 1, 2, 4]
    with pytest.raises(graphs.NoPath):
        graphs.path_to(paths, 9)


def test_blobs_are_written_once_and_verified(spark, tmp_path):
    root = corpus.root_of("fs", f"{tmp_path}/blobs")
    rows = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"two"),), (bytearray(b"one"),)], "content binary").withColumn("key", F.sha2("content", 256))
    corpus.write_blobs(rows, None, root)
    corpus.write_blobs(rows, corpus.read_blobs(spark, root), root)
    got = corpus.read_blobs(spark, root).collect()
    assert len(got) == 2 and all(r.intact for r in got)
    spark.createDataFrame([(bytearray(b"bad"), "f" * 64)], "content binary, key string").withColumn("shard", F.lit("ff")).write.mode("append").partitionBy("shard").parquet(root)
    assert [r.intact for r in corpus.read_blobs(spark, root).where(F.col("key") == "f" * 64).collect()] == [False]
    with pytest.raises(ValueError):
        corpus.root_of("fs", "a/../b")


def test_ranking_pipeline(spark):
    captures = spark.createDataFrame([(1, "complete"), (2, "complete"), (3, "partial")], "capture_id int, status string")
    members = spark.createDataFrame([(c, 10 * c + k, n) for c in (1, 2, 3) for k, n in enumerate(("alpha", "bravo", "charlie", "delta"))], "capture_id int, member_id int, name string")
    reads = [(1, 0, 0, "alpha"), (1, 1, 0, "br4vo"), (1, 1, 1, "bravo"), (1, 2, 0, "charlie"), (1, 3, 0, "alpha"), (2, 0, 0, "alpha"), (2, 1, 0, "??????")]
    points = [(1, 0, "9,000", 0.95), (1, 1, "8,5?0", 0.9), (1, 2, "8,000 x", 0.9), (1, 3, "1", 0.9), (2, 0, "5", 0.5), (2, 1, "4", 0.9)]
    reads = spark.createDataFrame(reads, "capture_id int, row int, mode int, text string")
    points = spark.createDataFrame([(*p, "", 0.0, "", 0.0) for p in points], "capture_id int, row int, text string, confidence double, retry_text string, retry_confidence double, late_text string, late_confidence double")
    got = ingest.ranking(captures, members, reads, points, score=names.edit_ratio)
    rows = {(r.capture_id, r.row): (r.outcome, r.value, r.reason) for r in got["rows"].collect()}
    assert rows == {(1, 0): ("fact", 9000, None), (1, 1): ("review", None, "unparseable_points"), (1, 2): ("fact", 8000, None), (1, 3): ("duplicate", None, None), (2, 0): ("review", None, "low_confidence_points"), (2, 1): ("review", None, "no_confident_match")}
    reviews = {(r.capture_id, r.row): (r.raw, [c["name"] for c in json.loads(r.candidates_json)]) for r in got["reviews"].collect()}
    assert reviews == {(1, 1): ("8,5?0 | retry: ", []), (2, 0): ("5", []), (2, 1): ("4", ["alpha", "bravo", "charlie", "delta"])}
    assert [(z.capture_id, z.member_id, z.value, z.confidence) for z in got["zeros"].collect()] == [(1, 13, 0.0, 0.9)]
    assert {r.capture_id: (r.matched, r.queued, r.duplicates, r.zeroed) for r in got["results"].collect()} == {1: (2, 1, 1, 1), 2: (0, 2, 0, 0), 3: (0, 0, 0, 0)}


def test_roster_pipeline(spark):
    members = spark.createDataFrame([(1, "R4", 5, "alpha")], "capture_id int, group string, member_id long, name string")
    rows = [(1, "R4", 0, "alpha", 0.9, None), (1, "R4", 1, "bravo", 0.9, 2), (1, "R4", 2, "zulu", 0.9, 9), (1, "R3", 0, "echo", 0.9, None)]
    rows = spark.createDataFrame(rows, "capture_id int, group string, ordinal long, name string, confidence double, expected int")
    fields = spark.createDataFrame([(1, "R4", 0, 1.5e6, 30, None, 0.9, 0.5, 0.9), (1, "R4", 1, 2e6, 31, 1.0, 0.9, 0.9, 0.9)], "capture_id int, group string, ordinal long, power double, level int, hours double, power_conf double, level_conf double, hours_conf double")
    got = ingest.roster(members, rows, fields, spark.createDataFrame([(1, None)], "capture_id int, stated int"))
    assert {(r.group, r.ordinal, r.outcome, r.member_id) for r in got["decisions"].collect()} == {("R4", 0, "matched", 5), ("R4", 1, "created", -1), ("R4", 2, "no_confident_match_group_full", None), ("R3", 0, "no_confident_match_group_count_unknown", None)}
    assert {(r.member_id, r.metric, r.value) for r in got["facts"].collect()} == {(5, "power", 1.5e6), (-1, "power", 2e6), (-1, "level", 31.0), (-1, "last_active_hours", 1.0)}
    assert sorted(r.reason for r in got["reviews"].collect()) == ["low_confidence_level", "no_confident_match_group_count_unknown", "no_confident_match_group_full", "unparseable_last_active"]
    assert got["captures"].first().status == "partial"


def test_streamed_upserts_equal_the_batch(spark, tmp_path):
    rows = [(i % 7, "m", "p", "s", "t", float(i), (i * 37 % 11) / 11, i) for i in range(90)]
    schema = "member_id int, metric string, period_key string, source string, observed_at string, value double, confidence double, arrival int"
    for k in range(3):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = stream.writeStream.foreachBatch(upserts.upsert_into(spark, f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.member_id: (r.value, r.confidence, r.fact_id) for r in upserts.current(spark, f"{tmp_path}/out").collect()}
    want = {r.member_id: (r.value, r.confidence, r.fact_id) for r in facts.upsert(spark.createDataFrame(rows, schema)).collect()}
    assert got == want
    # what a failed batch leaves behind is named by no manifest
    spark.createDataFrame(rows[:9], schema).withColumn("fact_id", F.lit(0)).write.parquet(f"{tmp_path}/out/bucket=0/v=99")
    assert upserts.current(spark, f"{tmp_path}/out").count() == len(want)
    # a batch that is run again gives the same rows
    upserts.upsert_into(spark, f"{tmp_path}/out")(spark.createDataFrame(rows[60:], schema), 2)
    assert {r.member_id: (r.value, r.confidence, r.fact_id) for r in upserts.current(spark, f"{tmp_path}/out").collect()} == want


def test_windows_and_stale_runs_as_streams(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:{k:02d}:00", k % 2, float(k)) for k in range(30)]
    spark.createDataFrame(rows, "run_id int, ts string, by int, value double").coalesce(1).write.parquet(f"{tmp_path}/a")
    events = upserts.replayed(spark, f"{tmp_path}/a", "run_id int, ts string, by int, value double")
    q = upserts.windowed_counts(events, "ts", "by", "10 minutes", "1 minute").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.start.minute, r.by, r.n, r.total) for r in spark.table("counted").collect()} == {(m, b, 5, sum(float(k) for k in range(m, m + 10) if k % 2 == b)) for m in (0, 10, 20) for b in (0, 1)}
    facts_in = events.selectExpr("by AS member_id", "'m' AS metric", "'p' AS period_key", "'s' AS source", "'t' AS observed_at", "value", "value / 100 AS confidence", "run_id AS arrival")
    q = upserts.best_readings(facts_in).writeStream.format("memory").queryName("best").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.member_id, r.value, r.fact_id) for r in spark.table("best").collect()} == {(0, 28.0, 0), (1, 29.0, 1)}
