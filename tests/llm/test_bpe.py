import hashlib
import random

import public_tokenizers as P
import pytest
import regex
import tiktoken

from sightline.llm import bpe
from tests.conftest import SF, SF01
from tests.llm.cases import awkward, docs

NAMES = ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")


def reference(name):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(name)), special_tokens={})


@pytest.mark.parametrize("name", NAMES)
def test_transducer_on_random_bytes_and_words(name):
    ranks = bpe.read_ranks(P.path(name))
    t, r, enc = bpe.Transducer(ranks), random.Random(5), reference(name)
    tokens = sorted(ranks)
    for _ in range(3000):
        piece = b"".join(r.choice(tokens) for _ in range(r.randint(1, 6))) if r.random() < 0.5 else bytes(r.choice(b"aeinorst lhd\n  .") for _ in range(r.randint(1, 40)))
        assert t.encode(piece) == enc._encode_single_piece(piece), piece


@pytest.mark.parametrize("name", NAMES)
def test_texts_equal_the_library(name):
    import duckdb

    whole, _ = bpe.encoder(P.path(name), P.PATTERN)
    enc = reference(name)
    texts = [r[0] for r in duckdb.sql(f"select text from read_parquet('{SF01}/documents.parquet')").fetchall()]
    texts += ["", " ", "  a", "a  b", "a \n b", "a b  c", "x\x1cy \x1c z", "it's we'll I'd 'quote' don't", "a" * 3000, " " * 3000, "\n" * 500 + "x", "½²Ⅷ 12٣ ab12", "é日本語\U0001f600\U0001f600 \U0001f600", "tail "] + [r[1] or "" for r in awkward()]
    for t in texts:
        import numpy as np

        assert np.frombuffer(whole.encode(t), "<u4").tolist() == enc.encode_ordinary(t), t[:80]


@pytest.mark.parametrize("states", [40, 10**6])
def test_long_pieces_are_emitted_before_they_end(monkeypatch, states):
    """Settled ids are given out while a piece is read, whatever its length, and none is taken back."""
    monkeypatch.setattr(bpe, "STATES", states)
    monkeypatch.setattr(bpe, "WINDOW", 8)
    monkeypatch.setattr(bpe, "LONG_PIECE", 40)
    t, r, enc = bpe.Transducer(bpe.read_ranks(P.path(NAMES[0]))), random.Random(8), reference(NAMES[0])
    for text in (b"a" * 3000, b"ab" * 700, bytes(r.choice(b"aeinorst lhd") for _ in range(4000)), b"--==" * 500):
        parts = list(t.emitted(iter(text)))
        want = enc._encode_single_piece(text)
        assert [i for p in parts for i in p] == want == t.encode(text)
        assert len(parts) > 5 and max(map(len, parts)) < len(want)


def test_small_memo(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    monkeypatch.setattr(bpe, "STATES", 50)
    t, enc = bpe.Transducer(bpe.read_ranks(P.path(NAMES[0]))), reference(NAMES[0])
    c = bpe.chunk_encoder(t, P.PATTERN)
    for k in range(40):
        text = " ".join(f"wörd{k}x{i}" for i in range(30))
        import numpy as np

        assert np.frombuffer(c.encode(text), "<u4").tolist() == enc.encode_ordinary(text)


def test_streaming_decode_in_any_portions():
    text = "é日本語\U0001f600 plain ασδ" * 20
    enc = reference(NAMES[0])
    ids = enc.encode_ordinary(text)
    table = [enc.decode_single_token_bytes(i) for i in range(50256)]
    for step in (1, 2, 3, 7):
        stream = bpe.StreamDecoder(table)
        parts = [stream.feed(ids[i : i + step]) for i in range(0, len(ids), step)]
        assert "".join(parts) + stream.close() == text and "�" not in "".join(parts)


def test_query_rows(spark):
    path, enc = P.path(NAMES[0]), reference(NAMES[0])
    for df in (docs(spark), spark.read.parquet(f"{SF}/documents.parquet"), docs(spark, [])):
        got = bpe.encode_decode(df, path, P.PATTERN, with_ids=True)
        want = []
        for r in df.collect():
            ids = enc.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)
        assert sorted(map(tuple, bpe.decode(got, path).collect())) == sorted((r.doc_id, r.text or "") for r in df.collect())


def test_pattern_is_the_public_one():
    assert regex.findall(P.PATTERN, "a bc") == ["a", " bc"]
