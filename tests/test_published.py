import os
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import headers
from sightline.sources import index, published
from sightline.sources.replay import Replay
from sightline.streaming import landing

ANCHOR = "screen string, anchor_id string, x1 double, y1 double, x2 double, y2 double, threshold double, reference_height int, template_height int, variance double"


def anchor(screen="home", name="a", threshold=0.5, y2=0.5, height=1600, template=20, variance=1.0):
    return (screen, name, 0.1, 0.1, 0.9, y2, threshold, height, template, variance)


def held(spark, root):
    return sorted((r.screen, r.anchor_id, r.threshold) for r in published.read(spark, root, "anchors").collect())


def test_anchors_are_added_and_replaced(spark, tmp_path):
    root = str(tmp_path)
    assert published.current(spark, root) is None
    with pytest.raises(LookupError):
        published.read(spark, root, "anchors")
    published.write_anchors(spark, root, spark.createDataFrame([anchor(), anchor(name="b")], ANCHOR))
    published.write_anchors(spark, root, spark.createDataFrame([anchor(name="b", threshold=0.9), anchor("shop", "b")], ANCHOR))
    assert held(spark, root) == [("home", "a", 0.5), ("home", "b", 0.9), ("shop", "b", 0.5)]


@pytest.mark.parametrize("bad", [anchor("Home"), anchor(name="../a"), anchor(threshold=1.5), anchor(y2=0.05), anchor(y2=1.2), anchor(height=1080), anchor(height=0), anchor(template=700), anchor(variance=0.0), anchor(variance=None), anchor(threshold=None), anchor(name=None)])
def test_faulty_anchors_leave_the_manifest_bit_by_bit(spark, tmp_path, bad):
    root = str(tmp_path)
    published.write_anchors(spark, root, spark.createDataFrame([anchor(name="z")], ANCHOR))
    files = lambda: {os.path.join(p, f): open(os.path.join(p, f), "rb").read() for p, _, fs in os.walk(root) for f in fs}
    before = files()
    with pytest.raises(published.Refused):
        published.write_anchors(spark, root, spark.createDataFrame([bad], ANCHOR))
    assert files() == before


def test_an_anchor_twice_in_a_write_is_refused(spark, tmp_path):
    with pytest.raises(published.Refused, match="twice"):
        published.write_anchors(spark, str(tmp_path), spark.createDataFrame([anchor(), anchor(threshold=0.1)], ANCHOR))
    assert published.current(spark, str(tmp_path)) is None


def test_rollback_and_a_number_that_is_taken(spark, tmp_path):
    root, one = str(tmp_path), lambda n: {"t": spark.range(n)}
    first = published.publish(spark, root, one(1))
    with pytest.raises(LookupError):
        published.rollback(spark, root)
    second = published.publish(spark, root, one(2))
    assert published.rollback(spark, root) == first and published.read(spark, root, "t").count() == 1
    assert published.read(spark, root, "t", second).count() == 2
    with pytest.raises(published.Refused):
        published._point(spark, root, 1, "another")
    assert published.current(spark, root) == first and not [f for f in os.listdir(root) if f.startswith("aside")]
    assert published.publish(spark, root, one(3)) == published.current(spark, root)


def test_frames_are_read_when_their_headers_are_there(spark, tmp_path):
    root, heads, rows = str(tmp_path), "capture_id long, status string", "capture_id long, seq int"
    assert [d.count() for d in published.recorded(spark, root, heads, rows)] == [0, 0]
    capture = spark.createDataFrame([(1, "complete")], heads)
    broken = capture.select(F.raise_error(F.lit("lost")).cast("long").alias("capture_id"), "status")
    frames = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], rows)
    with pytest.raises(Exception, match="lost"):
        published.record_captures(broken, frames, root, 0)
    assert landing.folders(spark, f"{root}/frames") and [d.count() for d in published.recorded(spark, root, heads, rows)] == [0, 0]
    for _ in range(2):
        published.record_captures(capture, frames, root, 0)
    assert sorted(tuple(r) for r in published.recorded(spark, root, heads, rows)[1].collect()) == [(1, 0), (1, 1)]


def test_index_of_any_style(spark, tmp_path):
    h = "a" * 64
    (tmp_path / "index.yaml").write_text(f"frames:\n    - hash: {h}\n      label: home\n      width: 900\n      height: 1600\n      captured_at: 2026-01-02T03:04:05.5Z\n      device: 'it''s one'\n      game_version: \"1.0\\t\\u00e9\"\n    - hash: {'b' * 64}\n      label: _unsorted\n      width: 0\n      height: 0\n      captured_at: 0001-01-01T00:00:00Z\n      device: \"\"\n      game_version: 1.2.3\n")
    got = {r.hash[0]: r for r in index.read_index(spark, str(tmp_path / "index.yaml")).withColumn("captured_at", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss.S")).collect()}
    assert tuple(got["a"]) == (h, "home", 900, 1600, "2026-01-02 03:04:05.5", "it's one", "1.0\té")
    assert tuple(got["b"]) == ("b" * 64, "_unsorted", None, None, None, None, "1.2.3")


def test_index_parts_in_order_are_one_file(spark, tmp_path):
    rows = spark.range(300).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.lit("home").alias("label"), F.lit(None).cast("int").alias("width"), F.lit(5).alias("height"), F.lit(None).cast("timestamp").alias("captured_at"), F.lit(None).cast("string").alias("device"), F.lit('a"b\\').alias("game_version")).repartition(7)
    path = str(tmp_path / "index")
    index.write_index(rows, path)
    text = "".join(open(f"{path}/{f}").read() for f in sorted(os.listdir(path)) if f.startswith("part-"))
    assert text.startswith("frames:\n    - hash: 0")
    (tmp_path / "one.yaml").write_text(text)
    want = [tuple(r) for r in rows.orderBy("hash").collect()]
    for place in (path, str(tmp_path / "one.yaml")):
        read = [tuple(r) for r in index.read_index(spark, place).collect()]
        assert sorted(read) == want
    index.write_index(rows.limit(0), path)
    assert index.read_index(spark, path).count() == 0


def test_replay_in_order_holds_the_last(spark, tmp_path):
    frames = tmp_path / "frames"
    frames.mkdir()
    for name in ("020_b.PNG", "010_a.png", "030_c.jpg", "notes.txt"):
        (frames / name).write_bytes(name.encode())
    spark.dataSource.register(Replay)
    rows = [(r.tick, r.name, bytes(r.content).decode()) for r in spark.read.format("replay").option("path", str(frames)).option("ticks", 130).load().orderBy("tick").collect()]
    assert [r[0] for r in rows] == list(range(130)) and [r[1] for r in rows[:4]] == ["010_a.png", "020_b.PNG", "030_c.jpg", "030_c.jpg"] and all(r[1] == r[2] for r in rows) and rows[-1][1] == "030_c.jpg"
    for ticks in (5, 5, 9):  # again with nothing new, then further
        stream = spark.readStream.format("replay").option("path", str(frames)).option("ticks", ticks).load()
        landing.drained(stream, landing.keep(str(tmp_path / "out")), str(tmp_path / "progress"))
    out = landing.committed(spark, str(tmp_path / "out"), stream.schema).orderBy("tick").collect()
    assert [r.tick for r in out] == list(range(9)) and [r.name for r in out[:3]] == ["010_a.png", "020_b.PNG", "030_c.jpg"]
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no images"):
        spark.read.format("replay").option("path", str(tmp_path / "none")).load().collect()


def plain_cards(bands, badges, top, bottom, least, gap, half, height):
    windows, at = [], top
    for lo, hi in sorted(bands):
        if lo > at:
            windows.append((at, lo))
        at = max(at, hi)
    if bottom > at:
        windows.append((at, bottom))
    out = []
    for start, stop in windows:
        best = {}
        for y, rank, score in badges:
            if start <= y < stop:
                best[rank] = max(best.get(rank, (-1.0, 0)), (score, -y))
        ranks = sorted(((s, up, r) for r, (s, up) in best.items()), reverse=True)
        if stop - start >= least and ranks:
            score, up, rank = ranks[0]
            lead = score - (ranks[1][0] if len(ranks) > 1 else 0.0)
            if lead >= gap and -up - half >= 0 and -up + half <= height:
                out.append((-up - half, rank, score, lead))
    return sorted(out)


def test_cards_and_owners_against_loops(spark):
    rng = random.Random(3)
    frames, bands, badges = [], [], []
    for f in range(60):
        frames.append((f, rng.choice(["R1", "R2", None])))
        bands += [(f, n, lo, lo + rng.randint(5, 12)) for n, lo in enumerate(rng.sample(range(10, 90), rng.choice([0, 1, 4])))]
        badges += [(f, rng.randint(0, 99), rng.choice(["R1", "R2", "R3"]), float(rng.randint(0, 9))) for _ in range(rng.randint(0, 7))]
    sticky = spark.createDataFrame(frames, "frame int, rank string")
    band = spark.createDataFrame(bands, "frame int, n int, lo int, hi int")
    badge = spark.createDataFrame(badges, "frame int, y int, rank string, score double")
    found = headers.cards(sticky, band, badge, ["frame"], 10, 95, 6, 2.0, 4, 97)
    want = {f: plain_cards([b[2:] for b in bands if b[0] == f], [b[1:] for b in badges if b[0] == f], 10, 95, 6, 2.0, 4, 97) for f, _ in frames}
    assert sorted(tuple(r) for r in found.collect()) == sorted((f, *c) for f, cs in want.items() for c in cs)
    owners = {(r.frame, r.n): r.owner for r in headers.owned(band, found, sticky, ["frame"]).collect()}
    for f, n, lo, _ in bands:
        rank = dict(frames)[f]
        expected = rank and next((c[1] for c in reversed(want[f]) if c[0] <= lo), rank)
        assert owners[f, n] == expected
    assert len(owners) == len(bands)
