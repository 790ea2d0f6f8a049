"""Names as recognised from images: normal forms and a likeness that knows which characters look alike."""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scores from which a likeness is taken for granted, or for a person to look at.
ACCEPT, REVIEW = 92, 75
#: Tenths of an edit: any edit, and the exchange of two characters that look alike.
EDIT, ALIKE = 10, 2

# Pairs of characters that look alike once lower-cased.
PAIRS = ["0o", "1i", "1l", "1t", "il", "5s", "8s", "9s", "6g", "9g", "8b", "6b", "2z", "tf", "ce", "uv"]

# Letters of other scripts, and the Latin ones that they are taken for.
FOLD_FROM = "АВЕКМНОРСТУХЅІЈҮавекмнорстухѕіјΑΒΕΖΗΙΚΜΝΟΡΤΥΧαβεικνορτυχγΔ∩ՈłŁøØđĐıİſ"
FOLD_TO = "ABEKMHOPCTYXSIJYabekmhopctyxsijABEZHIKMNOPTYXabeikvoptuxyANNlLoOdDiIs"

_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


def normal(s: str | None) -> str:
    """Letters and digits alone, decomposed, folded and lower-cased."""
    out = unicodedata.normalize("NFKD", s or "").translate(_FOLD)
    return "".join(c.lower() for c in out if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")


def normal_tokens(s: str | None) -> list[str]:
    """The same word by word."""
    return [t for t in (normal(w) for w in unicodedata.normalize("NFKD", s or "").split()) if t]


def _alike() -> np.ndarray:
    table = np.zeros((128, 128), bool)
    for x, y in PAIRS:
        table[ord(x), ord(y)] = table[ord(y), ord(x)] = True
    return table


def _codes(words: list[str], pad: int) -> np.ndarray:
    """Code points of words as rows of one array, the rest filled with pad."""
    out = np.full((len(words), max(map(len, words), default=0)), pad, np.int32)
    for k, w in enumerate(words):
        out[k, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.int32)
    return out


def distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Levenshtein distances in tenths of an edit, with cheap exchanges of characters that look alike; all pairs advance together, cell by cell of their tables."""
    if not pairs:
        return np.zeros(0, np.int32)
    left, right = ([p[k] for p in pairs] for k in (0, 1))
    a, b, alike = _codes(left, -1), _codes(right, -2), _alike()
    n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    rows, out = np.arange(len(pairs)), np.zeros(len(pairs), np.int32)
    before = np.broadcast_to(np.arange(b.shape[1] + 1, dtype=np.int32) * EDIT, (len(pairs), b.shape[1] + 1)).copy()
    out[n == 0] = m[n == 0] * EDIT
    for i in range(a.shape[1]):
        x = a[:, i : i + 1]
        near = alike[np.clip(x, 0, 127), np.clip(b, 0, 127)] & (x < 128) & (b < 128) & (x >= 0) & (b >= 0)
        swap = before[:, :-1] + np.where(x == b, 0, np.where(near, ALIKE, EDIT))
        best = np.minimum(swap, before[:, 1:] + EDIT)
        row = np.empty_like(before)
        row[:, 0] = EDIT * (i + 1)
        # an insertion costs the same everywhere, so its chain is a running minimum
        steps = np.arange(b.shape[1] + 1, dtype=np.int32) * EDIT
        row[:, 1:] = best
        row = np.minimum.accumulate(row - steps, axis=1) + steps
        done = n == i + 1
        out[done] = row[rows[done], m[done]]
        before = row
    return out


def distance(a: str, b: str) -> int:
    return int(distances([(a, b)])[0])


def ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Likeness from 0 to 100 of each pair."""
    longest = np.array([max(len(a), len(b)) for a, b in pairs], np.int64) * EDIT
    got = np.maximum(0, 100 * (longest - distances(pairs)) // np.maximum(longest, 1))
    return np.where([a == b for a, b in pairs], 100, got)


def ratio(a: str, b: str) -> int:
    return int(ratios([(a, b)])[0])


def _plain(s: str) -> str:
    inner = re.sub(r"\A[^\x00-\x7f]+|[^\x00-\x7f]+\Z", "", s)
    return inner or s


def _forms(name: str | None) -> tuple[str, str, str, str, bool]:
    """Of a name: the normal form, its words in order, the form without ornament at the ends, and its longer ASCII words if it has others."""
    words = sorted(normal_tokens(name))
    whole = normal(name)
    core = " ".join(t for t in words if t.isascii() and len(t) > 2)
    return whole, " ".join(words), _plain(whole), core, not all(t.isascii() for t in words)


def token_set_ratios(pairs: list[tuple[str | None, str | None]]) -> list[int]:
    """For each pair the best of four likenesses: of the names without blanks, of their sorted words, without ornament at the ends, and of their ASCII words of three letters or more if there are others; 0 if a side is empty."""
    forms = {n: _forms(n) for n in {n for p in pairs for n in p}}
    wanted: list[tuple[int, tuple[str, str]]] = []
    for k, (x, y) in enumerate(pairs):
        (wa, sa, pa, ca, fa), (wb, sb, pb, cb, fb) = forms[x], forms[y]
        if not wa or not wb:
            continue
        wanted += [(k, (wa, wb)), (k, (sa, sb))]
        if (pa, pb) != (wa, wb):
            wanted.append((k, (pa, pb)))
        if (fa or fb) and ca and cb:
            wanted.append((k, (ca, cb)))
    out = np.zeros(len(pairs), np.int64)
    distinct = list(dict.fromkeys(w for _, w in wanted))
    for lo in range(0, len(distinct), 20_000):
        part = distinct[lo : lo + 20_000]
        found = dict(zip(part, ratios(part).tolist(), strict=True))
        for k, w in wanted:
            if w in found:
                out[k] = max(out[k], found[w])
    return out.tolist()


def token_set_ratio(a: str | None, b: str | None) -> int:
    return token_set_ratios([(a, b)])[0]


@F.pandas_udf(T.StringType())
def normalised(s: pd.Series) -> pd.Series:
    return s.map(normal)


@F.pandas_udf(T.StringType())
def normalised_tokens(s: pd.Series) -> pd.Series:
    return s.map(lambda x: " ".join(normal_tokens(x)))


@F.pandas_udf(T.IntegerType())
def weighted_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(distances(list(zip(a.fillna(""), b.fillna(""), strict=True))), dtype="int32")


@F.pandas_udf(T.IntegerType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = list(zip(a, b, strict=True))
    distinct = list(dict.fromkeys(pairs))
    found = dict(zip(distinct, token_set_ratios(distinct), strict=True))
    return pd.Series([found[p] for p in pairs], dtype="int32")


def ascii_normal(c) -> Column:
    """normalised of an ASCII name, without Python."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def edit_ratio(a, b) -> Column:
    """ratio with every edit at full price, without Python."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100).otherwise(F.floor(100 * (longest - F.levenshtein(a, b)) / longest)).cast("int")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
