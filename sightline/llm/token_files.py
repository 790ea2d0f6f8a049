"""Operator 2: token ids of whole documents in Parquet list columns."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.chunks import ChunkEncoder, parts
from sightline.llm.common import Scratch, by_value, fits_broadcast, give_back, process_cache, text_or_empty

END = 0
#: Bytes of text encoded at a time, and texts at the most.
SLICE, TEXTS = 3 << 20, 2000
#: Words remembered for chunks that are new.
WORDS = 60_000
#: Writer settings: ids are dictionary-coded (50k distinct values fit one dictionary page), and numbers that run out of a dictionary, such
#: as doc_id and place, are delta-coded by the second data-page format. Small pages and their index let a reader of few documents or of the
#: metadata columns alone skip the rest; row groups bound what a reader holds.
LAYOUT = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20), "parquet.block.size": str(32 << 20), "parquet.page.size": str(128 << 10), "parquet.page.row.count.limit": "2000", "compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
SCHEMA = "doc_id long, n_tokens long, place long, part int, ids array<int>"


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others by number from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


def tokenizer_encoder(path: str, added: bool = True) -> Callable[[pa.Array, bytes], tuple[np.ndarray, np.ndarray]]:
    """Function from a column of texts, and the ids that end a text, to the ids of all and how many each has, by a tokenizer of the tokenizers library.

    Byte-level tokenizers encode by chunks: a run of letters goes to the model
    at once, whatever needs splitting or has an added token through the whole tokenizer. Other tokenizers encode every text
    in one piece. With `added`, an added token in a text gets its own id, as the library does by default; without it, it is plain text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added
    model, letters = tokenizer.model, byte_letters()

    def whole(text: str) -> bytes:
        (got,) = tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(got.ids, "<u4").tobytes()

    split = tokenizer.pre_tokenizer
    if tokenizer.normalizer is not None or not isinstance(split, pre_tokenizers.ByteLevel) or split.add_prefix_space or not split.use_regex:

        def each(texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
            data = [whole(text) + end for text in texts.to_pylist()]
            return np.frombuffer(b"".join(data), "<u4"), np.array([len(d) // 4 for d in data], np.int64)

        return each

    packed = [struct.pack("<I", i) for i in range(tokenizer.get_vocab_size())]
    blank = letters[32]

    def word(piece: str) -> bytes:
        if piece.isascii():
            mapped = piece.replace(" ", blank)
        else:
            mapped = piece.encode().decode("latin-1").translate(letters)
        return b"".join([packed[t.id] for t in model.tokenize(mapped)])

    chunks, marks = ChunkEncoder(word, whole, WORDS), [t.content for t in tokenizer.get_added_tokens_decoder().values()] if added else []

    def column(texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        marked = np.zeros(len(texts), bool)
        for m in marks:
            marked |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
        return chunks.encode_column(texts, marked, end)

    return column


def _encode_batches(path: str, added: bool):
    def run(batches):
        encode, place = process_cache(f"tokenizer {path} {added}", lambda: tokenizer_encoder(path, added), large=True), 0
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for lo, rows in parts(batch.column(1), SLICE, TEXTS):
                ids, counts = encode(batch.column(1).slice(lo, rows), end)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), pa.array(counts), pa.array(place + ends - counts), lists], ["doc_id", "n_tokens", "place", "ids"])
                place += int(ends[-1])
            del batch
            give_back()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, added: bool = True) -> None:
    """Encodes the whole text of each row (null: empty), appends END and writes files whose order, and the order of rows in each, is that of doc_id.

    place counts the ids before a document in its own file (number part). Rows that repeat a doc_id stand together, by their texts.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    out = texts.mapInArrow(_encode_batches(tokenizer, added), "doc_id long, n_tokens long, place long, ids array<int>").withColumn("part", F.spark_partition_id())
    out.select("doc_id", "n_tokens", "place", "part", "ids").write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files of write_tokens; what is selected and filtered by doc_id is all that a scan reads."""
    return spark.read.schema(SCHEMA).parquet(path)


def starts(tokens: DataFrame) -> DataFrame:
    """(part, before): ids in all files before each file; one row per file."""
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("m"))
    return sums.select("part", (F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("before"))


def _crc_batches(batches):
    for batch in batches:
        ids = batch.column(2)
        offsets = ids.offsets.to_numpy()
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc, pa.int64()), batch.column(3)], ["doc_id", "n_tokens", "ids_crc32", "start"])


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, added: bool = True) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it in doc_id order, n_tokens
    its own with the end id, ids_crc32 is over its ids as little-endian unsigned 32-bit words. Null text counts as empty and gives the end
    id alone. Rows that repeat a doc_id follow each other by text. An empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or Scratch(spark, "tokens").path("files")
    write_tokens(docs, path, tokenizer, added)
    tokens = read_tokens(spark, path)
    before = starts(tokens)
    if fits_broadcast(before, 100_000):  # one row per file
        before = F.broadcast(before)
    placed = tokens.join(before, "part").select("doc_id", "n_tokens", "ids", (F.col("before") + F.col("place")).alias("start"))
    return placed.mapInArrow(_crc_batches, "doc_id long, n_tokens long, ids_crc32 long, start long").select("doc_id", "start", "n_tokens", "ids_crc32")


by_value(__name__)
