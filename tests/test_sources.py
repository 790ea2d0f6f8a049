import json
import os

import pytest
from pyspark.sql import functions as F

from sightline import __main__ as command
from sightline.config import Settings
from sightline.functions import parse
from sightline.operators import evaluate
from sightline.sources import blobs, corpus, recognise, schemas
from tests.conftest import SF


def test_tables_are_made_once(spark):
    assert schemas.migrate(spark, "store_once") == list(schemas.TABLES)
    assert schemas.migrate(spark, "store_once") == []
    facts = spark.table("store_once.participation_facts")
    assert facts.schema["value"].dataType.simpleString() == "decimal(38,6)" and facts.schema["confidence"].dataType.simpleString() == "float"
    assert {f.name for f in facts.schema} == {f.name for f in schemas.schema("participation_facts")}
    spark.sql("DROP DATABASE store_once CASCADE")


def test_recognisers_are_called_in_batches(spark):
    crops = spark.createDataFrame([(k, bytearray(f"crop {k}".encode())) for k in range(7)], "id long, png binary")
    got = recognise.recognised(crops, lambda images: [(x.decode().upper(), len(x) / 10) for x in images], ["id"], wrap=lambda x: x + b"!").collect()
    assert {(r.id, r.text, r.confidence) for r in got} == {(k, f"CROP {k}!", 0.7) for k in range(7)}
    script = spark.createDataFrame([(k, f"t{k}", 0.1 * k) for k in range(7)], "n int, text string, confidence double")
    assert [r.text for r in recognise.scripted(crops, script, "id").orderBy("id").collect()] == [f"t{k}" for k in range(7)]
    assert recognise.accepted(recognise.scripted(crops, script, "id"), 0.35).count() == 3
    with pytest.raises(LookupError):
        recognise.scripted(crops, script.where("n < 5"), "id")


def test_settings_refuse_nonsense():
    assert Settings.load({}).accept == 92 and Settings.load({"SIGHTLINE_BLOB_BACKEND": "s3", "SIGHTLINE_BLOBS": "b"}).blob_root == "s3a://b"
    for bad in ({"SIGHTLINE_ACCEPT": "x"}, {"SIGHTLINE_WRITE": "2"}, {"SIGHTLINE_BLOB_BACKEND": "tape"}, {"SIGHTLINE_BLOBS": "a/../../b"}):
        with pytest.raises(ValueError):
            Settings.load(bad)


def test_command_lists_queries(capsys):
    assert command.main(["list"]) == 0 and "live_leaderboard" in capsys.readouterr().out.split()


def test_labelled_files_and_strays(spark, tmp_path):
    good = "ab" * 32
    for label, name in (("home", good), ("home", "notes"), ("_none", "cd" * 32)):
        os.makedirs(tmp_path / label, exist_ok=True)
        (tmp_path / label / f"{name}.png").write_bytes(b"x")
    (tmp_path / "home" / "readme.txt").write_text("x")
    got = {(r.label, r.hash, r.stray) for r in blobs.labelled_files(spark, str(tmp_path)).collect()}
    assert got == {("home", good, False), ("home", "notes", True), ("_none", "cd" * 32, False)}
    assert corpus.labelled(blobs.labelled_files(spark, str(tmp_path)).where("not stray")).count() == 2
    with pytest.raises(ValueError):
        corpus.relabel(spark.createDataFrame([(good, "home")], "hash string, label string"), spark.createDataFrame([(good, "Not a label")], "hash string, label string"))


def test_short_keys_are_not_sharded(spark):
    df = spark.createDataFrame([("abc",), ("abcd",)], "s string")
    assert [r.k for r in df.select(blobs.key(F.col("s")).alias("k")).collect()] == ["sha256/abc", "sha256/ab/cd/abcd"]


def test_confusion_as_a_square(spark):
    counts = evaluate.confusion(spark.createDataFrame([("a", "a"), ("a", ""), ("b", "a"), ("b", None)], "l string, p string"), "l", "p")
    got = evaluate.matrix(counts, ["a", "b"], ["<none>", "a", "b"])
    assert got.columns == ["label", "a", "b", "<none>"] and [tuple(r) for r in got.collect()] == [("a", 1, 0, 1), ("b", 1, 0, 1)]


def test_review_candidates_round_trip(spark):
    df = spark.createDataFrame([(json.dumps([{"member_id": 3, "name": "x", "score": 80}]),)], "j string")
    from sightline.operators import store

    assert [tuple(x) for x in df.select(store.candidates_of(F.col("j")).alias("c")).first().c] == [(3, "x", 80)]


def test_jitter_lies_between_its_bounds(spark):
    row = spark.range(1000).select(parse.jitter(2.0, 3.0, seed=1).alias("j")).agg(F.min("j"), F.max("j")).first()
    assert 2.0 <= row[0] < 2.1 and 2.9 < row[1] <= 3.0


def test_queries_are_named_once():
    from sightline.plans import base, registry

    with pytest.raises(ValueError):
        base.query()(registry.QUERIES["live_leaderboard"])
    assert SF
