import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from sightline.llm import queries as corpus
from tests.llm.cases import docs


def test_added_tokens_as_the_library_loads_them(spark, tmp_path):
    texts = ["a <|endoftext|> b", "plain text here", "x<|endoftext|>y z", "a < | b"]
    docs(spark, [(i, t, *[None] * 9) for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    t, want, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), [], 0
    for i, text in enumerate(texts):
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in corpus.QUERIES["op2_token_files"](spark, str(tmp_path)).collect()) == want
