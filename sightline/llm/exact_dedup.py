"""Operator 6: exact duplicates by owners in compressed radix tries."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import BROADCAST_ROWS, Scratch, by_value, fits_broadcast, row_key, slices, text_or_empty, without_rows
from sightline.llm.kernels import string_buffer

#: Bytes of text that a task's trie holds before it gives up subtrees.
TRIE_BYTES = 24 << 20
#: Rows read at a time.
ROWS = 500
#: Bytes of text in one returned batch.
BATCH_BYTES = 4 << 20
WHITE = b" \t\n\x0b\x0c\r"
#: What a node costs besides its label.
NODE = 200
LOCAL = "n_bytes long, hash long, body binary, chars long, owner long, row long, rows long, twins long"


def ahead(a: list, b: list) -> bool:
    """Whether owner a comes before b: most code points, then the smallest doc_id (a missing one last), then the smallest row key."""
    return (-a[0], a[1] is None, a[1] or 0, a[2]) < (-b[0], b[1] is None, b[1] or 0, b[2])


class Trie:
    """Compressed radix trie (Patricia trie) over byte strings; a terminal node holds its text's owner.

    A node is [label, children by first byte, owner]; an owner is [code points of the original, doc_id, row key, rows in all, rows equal to it].
    """

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.bytes = 0

    def insert(self, key: bytes, owner: list) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None]
                node[1][key[at]] = child
                self.bytes += len(key) - at + NODE
                node, at = child, len(key)
                break
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            rest = key[at : at + len(label)]
            lo, hi = 0, len(rest)  # the longest common prefix by halving: slices compare at memory speed
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if rest[:mid] == label[:mid] else (lo, mid - 1)
            upper = [label[:lo], {label[lo]: child}, None]
            child[0] = label[lo:]
            node[1][key[at]] = upper
            self.bytes += NODE
            node, at = upper, at + lo
        held = node[2]
        if held is None:
            node[2] = owner
            return
        rows = held[3] + owner[3]
        if held[:3] == owner[:3]:
            held[4] += owner[4]
        elif ahead(owner, held):
            held[:] = owner
        held[3] = rows

    def entries(self, head: bytes = b"", node: list | None = None):
        """(string, owner) of a subtree, of the whole trie without a node. head: what leads to the node."""
        stack = [(head, node or self.root)]
        while stack:
            head, node = stack.pop()
            head += node[0]
            if node[2]:
                yield head, node[2]
            stack += [(head, child) for child in node[1].values()]

    @staticmethod
    def weight(node: list) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node[0]) + NODE
            stack += node[1].values()
        return total

    def give_up(self, limit: int):
        """(string, owner) of the largest subtrees, taken out until at most `limit` bytes are left; one too large is opened and its own largest branches go."""
        while self.bytes > limit and self.root[1]:
            head, node = b"", self.root
            while True:
                first, child, weight = max(((k, c, self.weight(c)) for k, c in node[1].items()), key=lambda x: x[2])
                if weight <= max(limit, NODE) or not child[1]:
                    break
                head, node = head + child[0], child
            del node[1][first]
            self.bytes -= weight
            yield from self.entries(head, child)


def _owner_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[3:])], ["n_bytes", "hash", "body", "chars", "owner", "row", "rows", "twins"])


def _batched(rows):
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += row[0] + 64
        if size >= BATCH_BYTES:
            yield _owner_batch(out)
            out, size = [], 0
    if out:
        yield _owner_batch(out)


def local_owners(batches):
    """Owners among the rows (doc_id, text, code points, row key) of one task, in one trie. Over TRIE_BYTES its largest subtrees are given up, as partial owners."""

    def entries():
        trie = Trie()
        for batch in slices(batches, ROWS):
            buf, offsets = string_buffer(batch.column(1))
            data, at = buf.tobytes(), offsets.tolist()
            for k, (doc_id, chars, row) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                trie.insert(data[at[k] : at[k + 1]].translate(None, WHITE), [chars, doc_id, row, 1, 1])
                if trie.bytes > TRIE_BYTES:
                    yield from trie.give_up(TRIE_BYTES // 2)
        yield from trie.entries()

    yield from _batched((len(body), xxhash.xxh3_64_intdigest(body) - (1 << 63), body, *owner) for body, owner in entries())


def merged_owners(batches):
    """Owners of one shuffle partition, sorted by length and content hash, in one trie.

    Equal strings stand together in that order, so whatever is not of the key at
    hand is complete: over TRIE_BYTES the largest subtrees are given out and forgotten, but for strings of that key, which are put back.
    """

    def entries():
        trie, key = Trie(), None
        for batch in slices(batches, ROWS):
            cols = [c.to_pylist() for c in batch.columns]
            for n, h, body, *owner in zip(*cols, strict=True):
                if trie.bytes > TRIE_BYTES and (n, h) != key:
                    yield from trie.give_up(TRIE_BYTES // 2)
                key = n, h
                trie.insert(body, owner)
        yield from trie.entries()

    rows = []
    for body, owner in entries():
        rows.append((hashlib.sha256(body).digest(), owner[1], owner[2], owner[3], owner[4]))
        if len(rows) >= 20_000:
            yield _merged_batch(rows)
            rows = []
    if rows:
        yield _merged_batch(rows)


def _merged_batch(rows: list[tuple]) -> pa.RecordBatch:
    sha, *numbers = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), *(pa.array(c, pa.int64()) for c in numbers)], ["sha", "keep_id", "keep_row", "group_size", "twins"])


def normalised_digests(batches):
    """(doc_id, row key, sha256 of the text without white space) of each row."""
    for batch in slices(batches, ROWS):
        buf, offsets = string_buffer(batch.column(1))
        data, at = buf.tobytes(), offsets.tolist()
        sha = [hashlib.sha256(data[a:b].translate(None, WHITE)).digest() for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sha, pa.binary())], ["doc_id", "row", "sha"])


def _texts(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select("doc_id", text.alias("text"), F.length(text).cast("long").alias("chars"), row_key(F.col("doc_id"), text).alias("row"))


def owners(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised text: sha (its sha256), keep_id, keep_row (the owner's row key), group_size and twins (rows equal to the owner, itself included).

    Each task first inserts its own rows, so a text that a third of all rows
    share reaches the shuffle once a task; then strings are dealt by length and content hash, and each partition is one trie over whole byte strings.
    """
    dealt = _texts(docs).mapInArrow(local_owners, LOCAL).repartition("n_bytes", "hash").sortWithinPartitions("n_bytes", "hash")
    return dealt.mapInArrow(merged_owners, "sha binary, keep_id long, keep_row long, group_size long, twins long")


def _owned(docs: DataFrame) -> DataFrame:
    digests = _texts(docs).select("doc_id", "text", "row").mapInArrow(normalised_digests, "doc_id long, row long, sha binary")
    return digests.join(owners(docs), "sha")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space (space, tab to
    carriage return); the one with most code points before that stays, then the smallest doc_id. Null text is
    empty; all empty texts are one group. Rows that repeat a doc_id with an equal text count in group_size and share its fate; a null doc_id comes last. An empty table gives an empty one; other columns are ignored.
    The join back to the rows is an equi-join on the digest, whose large keys the adaptive skew join splits.
    """
    return _owned(docs).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of docs, whole, for each normalised text: the owner's.

    Documents are told apart by doc_id and text, so a row stays although another
    with its doc_id goes. Of rows equal in both one stays, the first by a hash of all its columns. Null text counts as empty, so of all texts without characters one row
    stays. An empty table gives an empty one; other columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    owned = scratch.keep(_owned(docs).select("doc_id", "row", (F.col("row") == F.col("keep_row")).alias("kept"), "twins"), "owned")
    gone = scratch.keep(owned.where("not kept").select("doc_id", "row").distinct(), "gone")
    left = without_rows(docs, gone)
    twins = scratch.keep(owned.where("kept and twins > 1").select("doc_id", "row").distinct(), "twins")
    if not twins.limit(1).count():
        return left
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = left.select(every.alias("all"), row_key(left["doc_id"], F.coalesce(left["text"], F.lit(""))).alias("key"))
    few = F.broadcast(twins) if fits_broadcast(twins, BROADCAST_ROWS) else twins
    one = Window.partitionBy("key").orderBy(F.xxhash64("all"))
    repeated = rows.join(few, rows["key"] == twins["row"], "left_semi").withColumn("rank", F.row_number().over(one)).where("rank = 1")
    return rows.join(few, rows["key"] == twins["row"], "left_anti").select("all").union(repeated.select("all")).select("all.*")


by_value(__name__)
