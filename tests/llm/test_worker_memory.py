import struct
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from sightline.llm import toxicity
from sightline.llm.chunks import ChunkEncoder
from tests.conftest import SF


def test_a_column_copies_little_of_what_earlier_ones_left():
    """Beside the memory itself a column may not need another of its size: two workers share an executor with its JVM."""
    ids = lambda text: struct.pack("<I", len(text))
    encoder, rows = ChunkEncoder(ids, ids), 120_000
    encode = lambda *texts: encoder.encode_column(pa.array(texts), np.zeros(len(texts), bool), bytes(4))
    encode(" ".join(["start", *(f"{k:x}z" for k in range(rows))]))
    assert len(encoder.seen) == rows
    tracemalloc.start()
    try:
        got, counts = encode("start ffz new", "start new")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.tolist() == [5, 4, 4, 0, 5, 4, 0] and counts.tolist() == [4, 3]
    assert peak < 40 * rows


def test_fit_starts_no_second_set_of_python_workers(spark, monkeypatch):
    """A table from Python rows is an RDD that workers of its own unpack; they stay, beside those of the stages that follow."""
    made, create = [], SparkSession.createDataFrame
    monkeypatch.setattr(SparkSession, "createDataFrame", lambda self, data, *a, **k: made.append(type(data)) or create(self, data, *a, **k))
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert toxicity.fit(docs, labels).weights
    assert made == [pa.Table]
