import zlib
from array import array

import public_tokenizers as P
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from sightline.llm import token_files
from tests.conftest import SF
from tests.llm.cases import awkward, docs

PATH = P.path("byte_bpe_50k.json")


def brute(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    return out


def test_matches_the_library(spark):
    extra = ["a  b", " x", "x ", "a \n b", "x<|endoftext|>y", "it's  don't ½² \x1c z", "  q"]
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    got = sorted(tuple(r) for r in token_files.token_files(df, PATH).collect())
    assert got == brute([tuple(r) for r in df.collect()])


def test_awkward_rows(spark):
    got = sorted(tuple(r) for r in token_files.token_files(docs(spark), PATH).collect())
    assert got == sorted(brute([r[:2] for r in awkward()]))
    assert token_files.token_files(docs(spark, []), PATH).count() == 0


def test_layout_and_selective_read(spark, tmp_path):
    out = str(tmp_path / "t")
    token_files.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), out, PATH)
    files = sorted(tmp_path.glob("t/*.parquet"))
    last = -1
    for f in files:
        meta = pq.ParquetFile(f).metadata
        group = meta.row_group(0)
        cols = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        ids = cols["ids.list.element"]
        assert "RLE_DICTIONARY" in ids.encodings and ids.has_dictionary_page
        assert all(c.has_offset_index and c.has_column_index for c in cols.values())
        low, high = cols["doc_id"].statistics.min, cols["doc_id"].statistics.max
        assert low > last
        last = high
    plan = token_files.read_tokens(spark, out).where("doc_id = 17").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,17)" in plan and "ids" not in plan.split("ReadSchema")[1]
