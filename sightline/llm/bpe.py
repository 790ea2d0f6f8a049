"""Operator 9: byte-level BPE encoding by a lazily determinised transducer, and streaming decoding by a UTF-8 state machine."""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sightline.llm.chunks import ChunkEncoder, parts
from sightline.llm.common import by_value, give_back, process_cache, text_or_empty

#: States of the transducer, words remembered, and chunks that columns remember, before they start anew: some 200 MB a worker in all.
STATES, MEMO, SEEN = 150_000, 60_000, 600_000
#: Bytes of text encoded at a time, and documents at the most.
SLICE, ROWS = 1 << 20, 1000
#: What stands behind each document of a column; its id is none of the text's.
END = bytes(4)
#: Ids decoded at a time.
FEED = 1 << 16
#: Bits of a token's id, and a rank that no merge has.
BITS, LOW, NEVER = 17, (1 << 17) - 1, 1 << 60
#: Bytes of a piece that are read before settled ids are given out; pieces from LONG_PIECE bytes on are emitted bit by bit.
WINDOW, LONG_PIECE = 256, 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """The merges of a rank table as a finite-state transducer over bytes.

    A list of tokens is an encoding exactly if each two neighbours, encoded
    together, give themselves; so the encoding of a prefix is that of a shorter prefix and one token more. A state is the set of ways in
    which the input may still go on: pairs of an open tail (a node in the trie of all tokens) and the token before it, the oldest
    first. Reading a byte lengthens the tails, drops those that no token continues, and yields the token that ends the encoding of
    what has been read: the first tail that is a token itself and agrees with the token before it. Tails are shorter than the longest token,
    which bounds the lookahead, and `emitted` gives out what is settled. States and transitions are made when first needed.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for i, t in self.tokens.items()}
        self.child: dict[int, int] = {}
        self.token_at, self.inner = [-1], [True]
        for t, i in ranks.items():
            node = 0
            for byte in t:
                key = node << 8 | byte
                self.inner[node] = True
                node = self.child.get(key, -1)
                if node < 0:
                    node = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
            self.token_at[node] = i
        self.halves: dict[int, tuple[int, int] | tuple[()] | None] = {}
        self.edges: tuple[dict, dict] = {}, {}
        self.reset()

    def reset(self) -> None:
        """Forgets states, transitions and pair checks."""
        self.pairs: dict[int, bool] = {}
        self.states: list[bytes] = []
        self.closed: list[int] = []
        self.ids: dict[bytes, int] = {}
        self.moves: dict[int, int] = {}
        self.state(bytes(8), -1)

    def state(self, ways: bytes, closed: int) -> int:
        """The number of the state with these ways, packed as 64-bit integers: a third of a tuple of them. The newest way tells the token that ended the encoding, so it is the state's own."""
        found = self.ids.get(ways)
        if found is None:
            found = self.ids[ways] = len(self.states)
            self.states.append(ways)
            self.closed.append(closed)
        return found

    def parts(self, token: int) -> tuple[int, int] | tuple[()] | None:
        """The two tokens that the last merge of a token joins; () for a byte, None if merging its bytes doesn't give the token."""
        if token not in self.halves:
            text, get = self.tokens[token], self.ranks.get
            found = [text[i : i + 1] for i in range(len(text))]
            while len(found) > 2:
                ranks = [get(a + b, NEVER) for a, b in zip(found, found[1:], strict=False)]
                least = min(ranks)
                if least == NEVER:
                    break
                at = ranks.index(least)
                found[at : at + 2] = [found[at] + found[at + 1]]
            self.halves[token] = () if len(found) == 1 else None if len(found) > 2 else (get(found[0]), get(found[1]))
        return self.halves[token]

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at an end of a token (0: left, 1: right) while its bytes are merged, each with the rank of the merge that uses it up."""
        found = self.edges[side].get(token)
        if found is None:
            found, inner = [(token, NEVER)], token
            while half := self.parts(inner):
                found.append((half[side], inner))
                inner = half[side]
            self.edges[side][token] = found
        return found

    def agree(self, before: int, token: int) -> bool:
        """Whether token may follow `before` (a token's id and 1, or 0 for nothing): no merge across their border is due while both its sides stand.

        Of merges of equal rank the left one comes first, so across the border it must come before the right side's own, and strictly before the left side's.
        """
        key = before << BITS | token
        found = self.pairs.get(key)
        if found is None:
            found = self.parts(token) is not None
            if found and before:
                text, get = self.tokens, self.ranks.get
                crossing = ((get(text[x] + text[y], NEVER), used, taken) for x, used in self.edge(before - 1, 1) for y, taken in self.edge(token, 0))
                found = not any(rank < used and rank <= taken and rank < NEVER for rank, used, taken in crossing)
            self.pairs[key] = found
        return found

    def move(self, state: int, byte: int) -> int:
        """The state after a byte; its `closed` is the token that ends the encoding so far."""
        child, token_at, inner, pairs = self.child.get, self.token_at, self.inner, self.pairs.get
        out, closed = [], -1
        for way in memoryview(self.states[state]).cast("q"):
            node = child(way >> BITS << 8 | byte)
            if node is None:
                continue
            before = way & LOW
            if inner[node]:
                out.append(node << BITS | before)
            if closed < 0 and (token := token_at[node]) >= 0:
                fits = pairs(before << BITS | token)
                if self.agree(before, token) if fits is None else fits:
                    closed = token
        if closed < 0:
            raise ValueError("the rank table lacks a byte or is no result of merging")
        out.append(closed + 1)
        to = self.moves[state << 8 | byte] = self.state(array("q", out).tobytes(), closed)
        return to

    def trace(self, ends: list[int], to: int) -> list[int]:
        """Tokens of the first `to` bytes, from the tokens that end the encoding of each prefix."""
        out, length = [], self.length
        while to:
            token = ends[to - 1]
            out.append(token)
            to -= length[token]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the splitting pattern; a match that is itself a token stays whole."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > LONG_PIECE:
            return [i for some in self.emitted(iter(piece)) for i in some]
        if len(self.states) > STATES:
            self.reset()
        state, ends, get, closed = 0, [], self.moves.get, self.closed
        for byte in piece:
            to = get(state << 8 | byte)
            state = self.move(state, byte) if to is None else to
            ends.append(closed[state])
        return self.trace(ends, len(ends))

    def emitted(self, piece) -> Iterator[list[int]]:
        """Ids of a piece of any length (an iterator of bytes), given out as soon as no further byte can change them: when all open ways go through them."""
        state, ends, starts = 0, [], [0]
        for byte in piece:
            to = self.moves.get(state << 8 | byte)
            if to is None:
                if len(self.states) > STATES:
                    kept = self.states[state], self.closed[state]
                    self.reset()
                    state = self.state(*kept)
                to = self.move(state, byte)
            # where the ways begin: the old ones in their order, as far as they go on, and the new one
            ways = memoryview(self.states[state]).cast("q")
            kept = [at for at, way in zip(starts, ways, strict=True) if (node := self.child.get(way >> BITS << 8 | byte)) is not None and self.inner[node]]
            ends.append(self.closed[to])
            state, starts = to, [*kept, len(ends)]
            if len(ends) >= 4 * WINDOW:
                common = None
                for at in starts:
                    passed = set()
                    while at:
                        passed.add(at)
                        at -= self.length[ends[at - 1]]
                    common = passed if common is None else common & passed
                if common:
                    cut = max(common)
                    yield self.trace(ends, cut)
                    ends, starts = ends[cut:], [at - cut for at in starts]
        yield self.trace(ends, len(ends))


class StreamDecoder:
    """Decodes ids fed in any portions; gives text up to the last complete code point.

    The state is what an unfinished code point has had so far: its lead byte
    says how many bytes follow. Bytes that are not UTF-8 become U+FFFD, as in a decode of the whole.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.open = tokens, b""

    def feed_bytes(self, ids: list[int]) -> bytes:
        data = self.open + b"".join(map(self.tokens.__getitem__, ids))
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            byte = data[cut - back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                if need > back:
                    cut -= back
                break
            if byte < 0x80:
                break
        self.open = data[cut:]
        return data[:cut]

    def feed(self, ids: list[int]) -> str:
        return self.feed_bytes(ids).decode("utf-8", "replace")

    def close_bytes(self) -> bytes:
        rest, self.open = self.open, b""
        return rest

    def close(self) -> str:
        return self.close_bytes().decode("utf-8", "replace")


def chunk_encoder(transducer: Transducer, pattern: str) -> ChunkEncoder:
    """Whole texts through the transducer, each match of the pattern separately."""
    split = regex.compile(pattern).findall

    def word(piece: str) -> bytes:
        own = transducer.encode(piece.encode())
        return struct.pack(f"<{len(own)}I", *own)

    return ChunkEncoder(word, lambda text: b"".join(map(word, split(text))), MEMO, SEEN)


def encoder(path: str, pattern: str) -> tuple[ChunkEncoder, list[bytes]]:
    """The worker's encoder for a rank file, and its tokens by id."""

    def make():
        t = Transducer(read_ranks(path))
        return chunk_encoder(t, pattern), [t.tokens.get(i, b"") for i in range(max(t.tokens) + 1)]

    return process_cache(f"bpe {path} {pattern}", make, large=True)


def encode_batches(path: str, pattern: str, with_ids: bool):
    """mapInArrow function over (doc_id, text): counts and digests, and the ids themselves if asked for."""

    def run(batches):
        chunks, tokens = encoder(path, pattern)
        digits = process_cache(f"digits {path}", lambda: [b"%d" % i for i in range(len(tokens))], large=True)
        for batch in batches:
            for lo, rows in parts(batch.column(1), SLICE, ROWS):
                ids, counts = chunks.encode_column(batch.column(1).slice(lo, rows), np.zeros(rows, bool), END)
                stops = np.cumsum(counts) - 1
                counts -= 1
                ids_sha, text_sha = [], []
                for first, stop in zip((stops - counts).tolist(), stops.tolist(), strict=True):
                    ids_digest, text_digest, stream = hashlib.sha256(), hashlib.sha256(), StreamDecoder(tokens)
                    for at in range(first, stop, FEED):
                        some = ids[at : min(at + FEED, stop)].tolist()
                        ids_digest.update((b"," if at > first else b"") + b",".join([digits[i] for i in some]))
                        text_digest.update(stream.feed_bytes(some))
                    text_digest.update(stream.close_bytes())
                    ids_sha.append(ids_digest.hexdigest())
                    text_sha.append(text_digest.hexdigest())
                cols = [batch.column(0).slice(lo, rows), pa.array(counts), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.delete(ids, stops).view("<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
                # arrays of a column leave the C library holding as much again as the worker uses
                del ids, cols
                give_back()
            del batch

    return run


def encode_decode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the bytes decoded from the ids), and ids if asked for.

    Each match of the pattern is encoded by itself, without special tokens. Null
    text counts as empty and has no tokens; texts of any length are read whole; repeated rows give a row each. An empty table gives an empty one; other columns are ignored.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(encode_batches(path, pattern, with_ids), schema)


def decode_batches(path: str):
    """mapInArrow function from (key, ids) to (key, text)."""

    def run(batches):
        def make():
            ranks = read_ranks(path)
            out = [b""] * (max(ranks.values()) + 1)
            for t, i in ranks.items():
                out[i] = t
            return out

        tokens = process_cache(f"tokens {path}", make, large=True)
        for batch in batches:
            out = []
            for ids in batch.column(1).to_pylist():
                stream = StreamDecoder(tokens)
                out.append("".join([stream.feed(ids[at : at + FEED]) for at in range(0, len(ids or ()), FEED)]) + stream.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [batch.schema.names[0], "text"])

    return run


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of a table with doc_id and ids; null ids decode to an empty text."""
    return tokens.select("doc_id", "ids").mapInArrow(decode_batches(path), "doc_id long, text string")


by_value(__name__)
