import time

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from sightline.llm import token_files
from sightline.llm.chunks import ChunkEncoder
from tests.llm.cases import awkward

PATH = P.path("byte_bpe_50k.json")
END = bytes(4)


def test_columns_have_the_ids_of_single_texts():
    texts = [r[1] or "" for r in awkward()] + ["a  b c", " x", "x ", "a b \n c", "x<|endoftext|>y", "it's  don't ½² \x1c z", "tail.\nhead, tail.\nhead", "é " * 300, "b" * 400 + " c"]
    t, encode = Tokenizer.from_file(PATH), token_files.tokenizer_encoder(PATH)
    want = [t.encode(text, add_special_tokens=False).ids + [0] for text in texts]
    for column in (pa.array(texts), pa.array(["x", *texts, "y"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
        for _ in range(2):  # the second time from memory
            ids, counts = encode(column, END)
            assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_chunks_are_encoded_once_a_column_and_forgotten_when_full(monkeypatch):
    monkeypatch.setattr("sightline.llm.chunks.SEEN", 3)
    code = lambda w: np.array([len(w)], "<u4").tobytes()
    asked, encoder = [], ChunkEncoder(code, code)
    missing = encoder.missing
    monkeypatch.setattr(encoder, "missing", lambda chunk: asked.append(chunk) or missing(chunk))
    texts = ["one two. six\nfive two.", "one two. six\nfive six\nfive", "alone"]
    want = [ChunkEncoder(code, code).encode(t) + END for t in texts]
    for _ in range(3):
        ids, counts = encoder.encode_column(pa.array(texts), np.zeros(3, bool), END)
        assert ids.tobytes() == b"".join(want) and counts.tolist() == [len(w) // 4 for w in want]
    assert asked.count("six\nfive") == 3 and asked.count("two.") == 1
    encoder.encode_column(pa.array(["a b c d", "e f g"]), np.zeros(2, bool), END)
    assert len(encoder.seen) <= 5


def test_known_chunks_cost_less_than_a_scalar_each():
    texts = pa.array([" ".join(f"w{k}x{i}" for i in range(200)) for k in range(500)])
    encoder = ChunkEncoder(lambda w: END, lambda w: END)
    distinct = pa.array([chunk for text in texts.to_pylist() for chunk in text.split(" ")])

    def took(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    known = lambda: encoder.encode_column(texts, np.zeros(500, bool), END)
    known()
    pairs = [(took(known), took(distinct.to_pylist)) for _ in range(9)]
    assert min(p[0] for p in pairs) < 1.1 * min(p[1] for p in pairs)
