"""Operator 7: secrets by patterns and by character Markov models. DataFrame functions only."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import text_or_empty
from sightline.llm.spans import apart, count_kind, joined, with_matches

# The patterns of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]

#: Strings that the models judge: long runs of key characters.
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
#: Ordinary identifiers in training: whole runs too short to be judged, so that secrets without a label don't teach the wrong model.
WORDS = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{4,15}(?![A-Za-z0-9+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Documents of the training sample at the most, about; taken by hash of doc_id.
FIT_DOCS = 20_000
#: Log-likelihood ratio that a secret reaches in all and for each transition.
TOTAL, EACH = 10.0, 0.3


def with_base(df: DataFrame) -> DataFrame:
    """Adds base, the spans of the fixed kinds in text by start, then kind. A run of hex digits or capitals of sufficient length is the same match as a longer pattern that is dropped when short."""
    df = with_matches(with_matches(with_matches(df, "text", ASSIGN, 0, "_0", group=2), "text", ACCESS, 1, "_1"), "text", HEX, 2, "_2")
    return df.withColumn("base", F.array_sort(F.concat(F.filter("_0", lambda s: F.length(s["body"]) >= 6), "_1", "_2"))).drop("_0", "_1", "_2")


def transitions(strings: DataFrame) -> DataFrame:
    """(label, a, b, n) of strings (label, s): how often character number b of the alphabet follows number a; 0 is any other or the beginning.

    Equal strings are counted before they are taken apart.
    """
    strings = strings.groupBy("label", "s").agg(F.count("*").alias("times"))
    chars = F.split("s", "")
    place = lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c))
    pairs = F.filter(F.zip_with(F.concat(F.array(F.lit("")), chars), chars, lambda a, b: F.struct(place(a).alias("a"), place(b).alias("b"))), lambda p: p["b"].isNotNull())
    return strings.where(F.length("s") > 0).select("label", "times", F.explode(pairs).alias("p")).groupBy("label", "p.a", "p.b").agg(F.sum("times").alias("n"))


def ratios(counts: list[tuple[str, int, int, int]]) -> list[float] | None:
    """Log-likelihood ratios of all transitions, random against ordinary, with one pseudocount each; None if a class is missing."""
    size = len(ALPHABET) + 1
    n: dict = {"random": defaultdict(int), "ordinary": defaultdict(int)}
    for label, a, b, k in counts:
        n[label][a, b] += k
    if not n["random"] or not n["ordinary"]:
        return None
    sums = {label: defaultdict(int) for label in n}
    for label, own in n.items():
        for (a, _), k in own.items():
            sums[label][a] += k
    p = lambda label, a, b: (n[label][a, b] + 1) / (sums[label][a] + size)
    return [round(math.log(p("random", a, b) / p("ordinary", a, b)), 4) for a in range(size) for b in range(size)]


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> list[float] | None:
    """The models from labelled samples: bodies of matched secrets are random strings, other words of the text ordinary ones.

    About fit_docs documents are read, a share by hash of doc_id; what is
    collected are counts over pairs of the alphabet, 69 by 69 for each class.
    """
    rows = docs.count()
    part = docs if rows <= fit_docs else docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * fit_docs / rows))
    texts = with_base(part.select(text_or_empty().alias("text")))
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    labelled = lambda strings, label: F.transform(strings, lambda s: F.struct(F.lit(label).alias("label"), s.alias("s")))
    both = F.concat(labelled(F.col("base.body"), "random"), labelled(F.regexp_extract_all(masked, F.lit(WORDS), F.lit(0)), "ordinary"))
    return ratios([tuple(r) for r in transitions(texts.select(F.explode(both).alias("x")).select("x.*")).collect()])


def ratio(string: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a string under the two models."""
    values = F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<double>")
    size = len(ALPHABET) + 1
    state = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"))

    def step(acc, c):
        to = F.instr(F.lit(ALPHABET), c)
        return F.struct(to.alias("at"), (acc["sum"] + F.element_at(values, acc["at"] * size + to + 1)).alias("sum"))

    return F.aggregate(F.split(string, ""), state, step, lambda acc: acc["sum"])


def secret_spans(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    Base spans follow the contract's patterns and stay as they are. The
    method adds, apart from them, runs of 16 or more key characters that look like a random string: the log-likelihood ratio of two
    character Markov models is at least TOTAL, and EACH for each character. Null text counts as empty; a text without spans has an empty string
    and its digest. Repeated rows give a row each. An empty table gives an empty one; other columns are ignored.
    """
    table = table if table is not None else fit(docs)
    found = with_base(docs.select("doc_id", text_or_empty().alias("text")))
    if table is None:
        found = found.withColumn("every", F.col("base"))
    else:
        found = with_matches(found, "text", CANDIDATE, 3, "long").withColumn("apart", apart("long", "base"))
        found = found.withColumn("random", F.filter("apart", lambda s: ratio(s["body"], table) >= F.greatest(F.lit(TOTAL), F.lit(EACH) * F.length(s["body"]))))
        found = found.withColumn("every", F.array_sort(F.concat("base", "random")))
    return found.select("doc_id", *(count_kind("base", k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(joined("base", KINDS), 256).alias("base_sha256"), joined("every", KINDS).alias("spans"), count_kind("every", 3).alias("n_markov"))
