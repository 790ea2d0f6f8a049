"""Awkward documents that every corpus operator must take."""

import re

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, key string, rep long, kept string, size string, copies string"

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))


def awkward():
    texts = [None, "", "   \n\t ", "one", "one", "One two\nthree", "a b c d e", "A B C D E", "a  b c d\te", LONG, LONG, LONG + " tail", "é日本 \U0001f600 x y", "same text here for all of us", "same text here for all of us"]
    return [(i * 3, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, "c", "k", 1, "x", "y", "z") for i, t in enumerate(texts)] + [(39, "same text here for all of us", None, "s1", 28, None, None, None, None, None, None)]


def docs(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOC_SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
