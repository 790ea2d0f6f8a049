"""Array kernels for word shingles and circulant MinHash, run inside mapInArrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from sightline.llm.common import by_value, process_cache

U64, U32 = np.uint64, np.uint32
#: Bytes hashed at a time.
CHUNK = 1 << 20
WIDTH = 5


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (xor-shift and odd multipliers)."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _tables() -> dict:
    rng = np.random.Generator(np.random.PCG64(20240229))
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    space = np.zeros(256, dtype=bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    base = int(rng.integers(1 << 62, dtype=np.uint64)) * 8 + 5
    inverse = pow(base, -1, 1 << 64)

    def powers(b: int, n: int) -> np.ndarray:
        out = np.full(n, b & (1 << 64) - 1, dtype=U64)
        out[0] = 1
        return np.cumprod(out, dtype=U64)

    return {
        "low": low, "space": space, "byte": rng.integers(0, 1 << 64, 256, dtype=np.uint64), "powers": powers, "base": base & (1 << 64) - 1, "inverse": inverse,
        "up": powers(base & (1 << 64) - 1, CHUNK * 2), "down": powers(inverse, CHUNK * 2), "coef": rng.integers(1 << 63, (1 << 64) - 1, WIDTH, dtype=np.uint64, endpoint=True) | U64(1),
    }


def _word_hashes(buf: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a byte buffer and the byte at which it begins; no word crosses a place in cuts."""
    t = process_cache("shingle_tables", _tables)
    if lower:
        buf = t["low"][buf]
    word = ~t["space"][buf]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(buf))]
    begins[inner] |= word[inner]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[inner - 1] |= word[inner - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = (t["up"], t["down"]) if len(buf) <= len(t["up"]) else (t["powers"](t["base"], len(buf)), t["powers"](t["inverse"], len(buf)))
    total = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(t["byte"][buf] * up[: len(buf)], dtype=U64, out=total[1:])
    return mix64((total[e] - total[s]) * down[s] + (e - s).astype(U64)), s


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all rows, the number of words in each row, and the byte at which each word begins.

    buf holds the rows' UTF-8 bytes one after the other, row i at offsets[i]
    to offsets[i + 1]. Rows are hashed in chunks of about CHUNK bytes; a
    longer row is cut at white space, so memory doesn't follow its length eightfold.
    """
    space = process_cache("shingle_tables", _tables)["space"]
    out, at, places = [], int(offsets[0]), []
    last = int(offsets[-1])
    while at < last:
        to = min(at + CHUNK, last)
        while to < last:  # on to the end of the word
            step = np.flatnonzero(space[buf[to : to + CHUNK]])
            cut = np.searchsorted(offsets, to)
            edge = int(offsets[cut]) if cut < len(offsets) else last
            found = to + int(step[0]) if len(step) else min(to + CHUNK, last)
            to = min(found, edge) if edge >= to else found
            if len(step) or to == edge:
                break
        h, s = _word_hashes(buf[at:to], offsets - at, lower)
        out.append(h)
        places.append(s + at)
        at = to
    h, place = (np.concatenate(out), np.concatenate(places)) if out else (np.zeros(0, U64), np.zeros(0, np.int64))
    return h, np.diff(np.searchsorted(place, offsets)), place


def shingle_sets(h: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row: runs of WIDTH words, or all the words of a shorter row as one; none without words."""
    coef = process_cache("shingle_tables", _tables)["coef"]
    n = len(h)
    sums = np.zeros(n, dtype=U64)
    for k in range(min(WIDTH, n)):
        sums[: n - k] += h[k:] * coef[k]
    full = mix64(sums)
    out, at = [], 0
    for c in counts.tolist():
        if c >= WIDTH:
            out.append(np.unique(full[at : at + c - WIDTH + 1]))
        elif c:
            with np.errstate(over="ignore"):
                out.append(mix64(np.array([(h[at : at + c] * coef[:c]).sum(dtype=U64) + U64(c)], dtype=U64)))
        else:
            out.append(np.zeros(0, U64))
        at += c
    return out


def _pi(x: np.ndarray, tmp: np.ndarray) -> None:
    """In place, the second permutation of the 32-bit ring."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, U32(shift), out=tmp)
        np.bitwise_xor(x, tmp, out=x)
        np.multiply(x, U32(factor), out=x)
    np.right_shift(x, U32(16), out=tmp)
    np.bitwise_xor(x, tmp, out=x)


def circulant_signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Circulant MinHash: a first permutation places the shingles on a ring, the second, shifted by k, yields coordinate k.

    Coordinate k of a set is min over x of pi(sigma(x) + k mod 2**32), with
    sigma and pi two fixed bijections; all coordinates come of these two. Sets must not be empty.
    """
    out = np.empty((len(sets), size), dtype=U32)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (total == 0 or total + len(sets[last]) <= 1 << 15):
            total += len(sets[last])
            last += 1
        z = (mix64(np.concatenate(sets[first:last]) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(U32)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[first : last - 1]]))).astype(np.int64)
        x, tmp = np.empty_like(z), np.empty_like(z)
        for k in range(size):
            np.add(z, U32(k), out=x)
            _pi(x, tmp)
            out[first:last, k] = np.minimum.reduceat(x, starts)
        first = last
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature, bands told apart."""
    coef = (np.arange(1, rows + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(U64)
    return mix64(mix64((parts + U64(1)) * coef).sum(axis=2, dtype=U64) + np.arange(1, bands + 1, dtype=U64) * U64(0xA0761D6478BD642F))


def string_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string array without nulls."""
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    kind = np.int64 if large else np.int32
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def list_array(rows: list[np.ndarray]) -> pa.Array:
    """list<long> of arrays of 64-bit words."""
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    values = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


by_value(__name__)
