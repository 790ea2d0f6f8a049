"""Texts cut where byte-level tokenizers part them for certain, so that ids of what recurs are looked up; shared by token files and BPE."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sightline.llm.common import by_value

#: Entries of the memo of chunks before it starts anew, about 200 bytes each; that of other pieces holds a third as many.
MEMO = 500_000
#: Chunks that columns remember, about 60 bytes each.
SEEN = 1_500_000
#: Characters that, behind a letter, the splitting pattern parts from it, and that begin no contraction.
PUNCTUATION = ".,!?;:$%&*#|"
#: Runs of letters that are letters in every version of Unicode that a tokenizer may know.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
#: Longer chunks are encoded without being remembered.
LONG = 256


class ChunkEncoder:
    """Encodes whole texts in chunks that begin with a single space between two other characters.

    The splitting pattern (contractions; letters, digits and others, each with
    one leading space; white space) never joins what such a space divides, nor a single line feed between two other characters with
    them, nor letters with punctuation behind them. So a chunk's ids depend on it alone and are kept for its next occurrence. A text with
    other white space at a chunk's edge is encoded as a whole.

    word encodes a run of letters, with or without a leading space; text encodes anything. Both give ids as little-endian 32-bit words.
    """

    def __init__(self, word: Callable[[str], bytes], text: Callable[[str], bytes], entries: int | None = None, most: int | None = None):
        self.word, self.text, self.entries, self.most = word, text, entries or MEMO, most or SEEN
        self.memo: dict[str, bytes | None] = {}
        self.known: dict[str, bytes] = {}
        self.forget()

    def piece(self, piece: str, encode: Callable[[str], bytes]) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = self.known[piece] = encode(piece)
        return found

    def missing(self, chunk: str) -> bytes | None:
        """Ids of " " + chunk; None if the chunk can't be encoded by itself."""
        if LETTERS(chunk):
            found = self.memo[chunk] = self.word(" " + chunk)
            return found
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        if len(chunk) > LONG:
            return self.text(" " + chunk)
        first, *rest = chunk.split("\n")
        if first[-1].isspace():
            return None
        found = self.line(first, " ")
        for line in rest:
            if not line or line[0].isspace() or line[-1].isspace():
                return None
            found += self.piece("\n", self.text) + self.line(line, "")
        if not rest:
            self.memo[chunk] = found
        return found

    def line(self, line: str, lead: str) -> bytes:
        base = line.rstrip(PUNCTUATION)
        if not LETTERS(base):
            return self.piece(lead + line, self.text)
        if not lead:
            word = self.piece(base, self.word)
        elif (word := self.memo.get(base)) is None:
            word = self.memo[base] = self.word(lead + base)
        return word if len(base) == len(line) else word + self.piece(line[len(base) :], self.text)

    def tidy(self) -> None:
        if len(self.memo) > self.entries:
            self.memo.clear()
        if len(self.known) > self.entries // 3:
            self.known.clear()

    def encode_column(self, texts: pa.Array, whole: np.ndarray, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (without nulls) one after the other, each followed by end, and how many each has. Chunks known from earlier columns are looked up, others encoded, once a column; texts marked in whole are not cut."""
        self.tidy()
        chunks = pc.split_pattern(texts, " ")
        begins = chunks.offsets.to_numpy().astype(np.int64)
        values = chunks.values.slice(begins[0], begins[-1] - begins[0])
        begins -= begins[0]
        first = begins[:-1]
        heads = values.take(pa.array(first)).to_pylist()
        # the chunks that stand behind a space
        later = np.ones(len(values), bool)
        later[first] = False
        coded = values.dictionary_encode()
        # a column becomes Python's strings at once by numpy, to_pylist makes a scalar of each first
        every, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        behind = np.zeros(len(every), bool)
        behind[code[later]] = True
        # names are found by Python's hash and compared, as a dictionary does, but at a quarter of its memory
        hashes = np.fromiter(map(hash, every), np.int64, len(every))
        # looked up in order, the search stays in the processor's caches
        order = np.argsort(hashes)
        near = np.searchsorted(self.hashes, hashes[order])
        known = np.full(len(every), -1, np.int32)
        inside = near < len(self.places)
        known[order[inside]] = self.places[near[inside]]
        same = pc.equal(self.seen.take(pa.array(known, mask=known < 0)), coded.dictionary)
        known[~pc.fill_null(same, False).to_numpy(zero_copy_only=False)] = -1
        new, old = np.flatnonzero(behind & (known < 0)), np.flatnonzero(behind & (known >= 0))
        names = [every[k] for k in new.tolist()]
        found = [self.missing(chunk) for chunk in names]
        alone = np.fromiter((ids is None for ids in found), bool, len(found))
        no = np.zeros(len(every), bool)
        no[new] = alone
        no = no[code] & later
        whole = whole | (np.diff(begins) == 1) | np.logical_or.reduceat(no, first) | np.fromiter((not head or head[-1].isspace() for head in heads), bool, len(heads))
        # of a whole text its first place stands for all of it
        firsts = [self.piece(head, self.text) if not w else self.text(texts[k].as_py()) if len(texts[k].as_py()) else b"" for k, (head, w) in enumerate(zip(heads, whole.tolist(), strict=True))]
        # ids of this column's chunks alone: remembered ones, new ones, and of each text its first place
        spans = self.stops[known[old]], self.stops[known[old] + 1] - self.stops[known[old]]
        some = [b"" if ids is None else ids for ids in found]
        table = np.concatenate((gathered(self.ids, *spans), np.frombuffer(b"".join(some), "<u4"), np.frombuffer(b"".join(firsts) + end, "<u4")))
        lengths = np.concatenate((spans[1], np.fromiter(map(len, some + firsts), np.int64, len(some) + len(firsts)) // 4))
        starts = np.cumsum(lengths) - lengths
        place = np.zeros(len(every), np.int64)
        place[old], place[new] = np.arange(len(old)), len(old) + np.arange(len(new))
        code = place[code]
        code[first] = len(old) + len(new) + np.arange(len(first))
        per = lengths[code]
        gone = np.repeat(whole, np.diff(begins))
        gone[first] = False
        per[gone] = 0
        counts = np.add.reduceat(per, first) + 1
        # the end behind each text's last place
        per, at = np.insert(per, begins[1:], 1), np.insert(starts[code], begins[1:], len(table) - 1)
        out = gathered(table, at, per)
        fresh = len(self.seen) + len(new) <= self.most
        # beyond that only this column's chunks stay
        at = (new if fresh else np.flatnonzero(behind)).tolist()
        at = np.array([k for k in at if len(every[k]) <= LONG and "\n" not in every[k] and lengths[place[k]]], np.int64)
        if not fresh:
            self.forget()
        # of names with equal hashes one is remembered
        at = at[np.unique(hashes[at], return_index=True)[1]]
        into = np.searchsorted(self.hashes, hashes[at])
        other = into == np.searchsorted(self.hashes, hashes[at], side="right")
        at, into = at[other], into[other]
        self.places = np.insert(self.places, into, (len(self.seen) + np.arange(len(at))).astype(np.int32))
        self.hashes = np.insert(self.hashes, into, hashes[at])
        self.seen = pa.concat_arrays([self.seen, coded.dictionary.take(pa.array(at)).cast(pa.string())])
        per, at = lengths[place[at]], starts[place[at]]
        self.ids = np.concatenate((self.ids, gathered(table, at, per)))
        self.stops = np.concatenate((self.stops, (self.stops[-1] + np.cumsum(per)).astype(np.int32)))
        return out, counts

    def forget(self) -> None:
        self.seen, self.hashes, self.places = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.stops = np.zeros(0, "<u4"), np.zeros(1, np.int32)

    def encode(self, text: str) -> bytes:
        self.tidy()
        chunks = text.split(" ")
        first = chunks.pop(0)
        if not chunks or not first or first[-1].isspace():
            return self.text(text) if text else b""
        out = list(map(self.memo.get, chunks))
        if None in out:
            missing = self.missing
            for k, ids in enumerate(out):
                if ids is None:
                    out[k] = found = missing(chunks[k])
                    if found is None:
                        return self.text(text)
        return self.text(first) + b"".join(out)


def gathered(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of a table, one after the other."""
    return table[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]


def parts(texts: pa.Array, size: int, rows: int):
    """First row and rows of parts of a column of about so many bytes, or one longer text, and so many rows at the most."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = ends[lo - 1] if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield lo, hi - lo
        lo = hi


by_value(__name__)
