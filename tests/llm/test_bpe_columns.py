import hashlib

import public_tokenizers as P
import pyarrow as pa

from sightline.llm import bpe
from sightline.llm.common import process_cache
from tests.llm.cases import awkward
from tests.llm.test_bpe import NAMES, reference

PATH = P.path(NAMES[0])


def rows_of(texts, with_ids=False):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    return [r for b in bpe.encode_batches(PATH, P.PATTERN, with_ids)(iter([batch.slice(0, 3), batch.slice(3), batch.slice(0, 0)])) for r in b.to_pylist()]


def test_words_of_a_column_are_encoded_once(monkeypatch):
    """Also when the column has more words than the memo of words, as it had to be begun anew before."""
    monkeypatch.setattr(bpe, "MEMO", 20)
    process_cache("large", dict).clear()
    asked, encode = [], bpe.Transducer.encode
    monkeypatch.setattr(bpe.Transducer, "encode", lambda self, piece: asked.append(piece) or encode(self, piece))
    text = " ".join(["start", *(f"wörd{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200))])
    got = rows_of([text] * 12)
    process_cache("large", dict).clear()
    assert len({r["ids_sha256"] for r in got}) == 1 and len(got) == 12
    assert asked.count(b" " + "wördcc".encode()) == 1


def test_columns_have_the_rows_of_single_texts(monkeypatch):
    monkeypatch.setattr(bpe, "FEED", 7)
    texts = [r[1] or "" for r in awkward()] + ["", "a b  c", " x", "x ", "x\x1cy \x1c z", "é日本語\U0001f600\U0001f600 \U0001f600", "it's we'll don't", "a" * 3000, "tail.\nhead, tail.", "one " * 2000]
    enc = reference(NAMES[0])
    for size in (40, 1 << 20):
        monkeypatch.setattr(bpe, "SLICE", size)
        for text, r in zip(texts, rows_of(texts, with_ids=True), strict=True):
            ids = enc.encode_ordinary(text)
            assert r["ids"] == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
