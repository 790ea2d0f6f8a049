"""Rows without any value at all, next to others."""

import pytest

from sightline.llm import queries as corpus
from tests.llm.cases import DOC_SCHEMA

LINE = " ".join(f"word{i}" for i in range(40))
ROWS = [(None, None), (None, LINE), (None, LINE), (1, LINE), (2, LINE + " more"), (2, LINE + " more"), (3, None)]


@pytest.mark.parametrize("name", sorted(set(corpus.QUERIES) - {"pipeline", "op11_whitened_embeddings", "embedding_deviations"}))
def test_null_ids(spark, tmp_path, name):
    spark.createDataFrame([(*r, *[None] * 9) for r in ROWS], DOC_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, 0), (None, 1, None), (2, 1, 1), (2, 0, 0), (3, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(got) == {"op5_paragraph_repeats": 5, "op12_source_divergence": 0}.get(name, len(ROWS))
