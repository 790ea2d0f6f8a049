"""Operator 13: quality rules, an ordered list of threshold conjunctions learned from labelled statistics by sequential covering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import Scratch, by_value, text_or_empty
from sightline.llm.kernels import mix64, string_buffer, words

#: Labelled documents that a list is learned from at the most: the rows with the smallest hash. Statistics cover every document.
FIT_ROWS = 20_000
#: Conditions of a rule and rules of a list.
CONDITIONS, RULES = 4, 24
#: A rule stays if so many of the labelled documents that it rejects are bad ones, at least, among those it was pruned on, and if it rejects SUPPORT bad ones in all.
PRECISION, SUPPORT = 0.8, 5
#: Words of the windows in which repeats are looked for.
WINDOW = 5
#: Bytes of text measured at a time.
SLICE = 1 << 20
#: Counts of a text. The symbols of n_symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_calls", "n_distinct_words")
#: What rules have thresholds on, as SQL over COUNTS; each is 0 where there is nothing to divide by.
RATES = {
    "n_words": "n_words",
    "word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "calls_per_word": "n_calls / n_words",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "repeated_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct_words / n_words",
    "words_per_line": "n_words / n_lines",
    "duplicate_line_share": "n_dup_lines / n_lines",
}


@dataclass(frozen=True)
class Rule:
    """A conjunction of (rate, is it a lower bound, bound), and how many bad and good labelled documents it was first to reject."""

    conditions: tuple[tuple[str, bool, float], ...]
    bad: int = 0
    good: int = 0

    def sql(self) -> str:
        return " AND ".join(f"{rate} {'>=' if lower else '<'} {bound!r}D" for rate, lower, bound in self.conditions)


def _slices(column: pa.Array):
    """First row, bytes and offsets of runs of rows of about SLICE bytes."""
    buf, offsets = string_buffer(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, side="right")) - 1)
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _repeated_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and how many of them are equal to an earlier one."""
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


def _distinct(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers the distinct pairs of key and row, and how often each occurs."""
    _, which, often = np.unique(mix64(key + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    return which, often


def _windows(h: np.ndarray) -> np.ndarray:
    """A hash of the WINDOW words from each word on; without meaning at the last ones."""
    out = h.copy()
    for k in range(1, WINDOW):
        out[: len(h) - k] += h[k:] * np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64) | 1)
    return mix64(out)


def measure(column: pa.Array):
    """First and last row of a part of a string array, and COUNTS of its texts."""
    lookup = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
    space, symbols, calls = lookup(b" \t\n\r\x0b\x0c"), lookup(SYMBOLS), lookup(b"!?")
    for lo, hi, buf, cuts in _slices(column):
        per_row = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[cuts])
        h, counts, _ = words(buf, cuts, lower=False)
        row, ends = np.repeat(np.arange(hi - lo), counts), np.cumsum(counts)
        first = np.flatnonzero(np.arange(len(h)) + WINDOW <= ends[row]) if len(h) else np.zeros(0, np.int64)
        edge = np.zeros(len(h) + 1, np.int64)
        if len(first):
            which, often = _distinct(_windows(h)[first], row[first])
            found = first[often[which] > 1]
            np.add.at(edge, found, 1)
            np.add.at(edge, found + WINDOW, -1)
        repeated = np.bincount(row, weights=np.cumsum(edge[:-1]) > 0, minlength=hi - lo) if len(h) else np.zeros(hi - lo)
        distinct = np.zeros(hi - lo)
        if len(h):
            which, often = _distinct(h, row)
            distinct = np.bincount(row, weights=1.0 / often[which], minlength=hi - lo)
        lines = np.array([_repeated_lines(t) for t in column.slice(lo, hi - lo).to_pylist()])
        upper, digits = (buf >= 65) & (buf <= 90), (buf >= 48) & (buf <= 57)
        found = [counts, per_row(~space[buf] & ((buf & 0xC0) != 0x80)), per_row(symbols[buf]), lines[:, 1], repeated, lines[:, 0], per_row(upper), per_row(digits), per_row(calls[buf]), np.rint(distinct)]
        yield lo, hi, dict(zip(COUNTS, (np.asarray(x).astype(np.int64) for x in found), strict=True))


def _measured(batches):
    for batch in batches:
        for lo, hi, found in measure(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, found.values())], ["doc_id", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each whole text (null: none): words between white space, code points in them, symbols, repeated lines, words in repeated five-word windows, lines with a word, capitals and digits of ASCII, marks of exclamation or question, distinct words. Words and windows are compared by 64-bit hashes within a text."""
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_measured, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def with_rates(stats: DataFrame) -> DataFrame:
    """Adds the columns of RATES as doubles."""
    safe = lambda sql: F.coalesce(F.expr(f"try_divide({sql.split(' / ')[0]}, {sql.split(' / ')[1]})"), F.lit(0.0)) if " / " in sql else F.expr(sql)
    return stats.withColumns({rate: safe(sql).cast("double") for rate, sql in RATES.items() if rate != sql})


def _best_condition(x: np.ndarray, bad: np.ndarray, held: list) -> tuple[float, tuple | None]:
    """The condition with the most gain (Quinlan's FOIL): bad documents kept in, times the bits by which their share grows. Bounds lie halfway between neighbouring values."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best: tuple[float, tuple | None] = (1e-9, None)
    if not p0 or not n0:
        return best
    for f, rate in enumerate(RATES):
        order = np.argsort(x[:, f], kind="stable")
        v, y = x[order, f], bad[order]
        edges = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(edges):
            continue
        below_bad = np.concatenate(([0], np.cumsum(y)))[edges]
        below_good = edges - below_bad
        for lower, p, n in ((False, below_bad, below_good), (True, p0 - below_bad, n0 - below_good)):
            gain = p * (np.log2((p + 1e-12) / (p + n)) - np.log2(p0 / (p0 + n0)))
            k = int(np.argmax(gain))
            bound = float((v[edges[k] - 1] + v[edges[k]]) / 2)
            bound = bound if bound > v[edges[k] - 1] else float(v[edges[k]])
            if gain[k] > best[0] and (rate, lower, bound) not in held:
                best = (float(gain[k]), (rate, lower, bound))
    return best


def _covers(x: np.ndarray, conditions) -> np.ndarray:
    names = list(RATES)
    out = np.ones(len(x), bool)
    for rate, lower, bound in conditions:
        v = x[:, names.index(rate)]
        out &= (v >= bound) if lower else (v < bound)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> list:
    conditions: list = []
    inside = np.ones(len(x), bool)
    while len(conditions) < CONDITIONS:
        _, found = _best_condition(x[inside], bad[inside], conditions)
        if found is None:
            break
        conditions.append(found)
        inside &= _covers(x, [found])
    return conditions


def _prune(x: np.ndarray, bad: np.ndarray, conditions: list) -> list:
    """The beginning of the rule that is worth most, (bad - good) / (bad + good), on documents that it wasn't grown on; of equals the shortest."""

    def worth(some) -> float:
        hit = _covers(x, some)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((conditions[:k] for k in range(1, len(conditions) + 1)), key=lambda c: (worth(c), -len(c)), default=[])


def learn(rates: np.ndarray, bad: np.ndarray, prune: np.ndarray) -> list[Rule]:
    """Sequential covering: a rule is grown on one part of the documents, pruned on the rest (`prune`), and what it covers is set aside; until no rule is worth keeping. rates: a column for each of RATES."""
    rules: list[Rule] = []
    left = np.ones(len(rates), bool)
    while len(rules) < RULES:
        grow, test = left & ~prune, left & prune
        conditions = _prune(rates[test], bad[test], _grow(rates[grow], bad[grow]))
        if not conditions:
            break
        hit = left & _covers(rates, conditions)
        held = hit & prune
        if not (hit & bad).sum() >= SUPPORT or not (held & bad).sum() >= max(1.0, PRECISION * held.sum()):
            break
        rules.append(Rule(tuple(conditions), int((hit & bad).sum()), int((hit & ~bad).sum())))
        left &= ~hit
    return rules


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """A list from statistics() (best a written table) and labels (doc_id, quality of 0 or 1).

    Documents that fail the base rules take no part. Of the labelled rows the fit_rows with the smallest hash are used, and a third of them (by another
    hash) prune. Labels that are null or of no document are ignored; of repeated ones the lowest holds; of rows that share a doc_id each counts. Without two classes there are no rules.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    rows = with_rates(stats.where(~base_failed())).join(known, "doc_id").withColumn("prune", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(3)) == 0)
    kept = rows.select("doc_id", *[F.col(c).cast("double").alias(c) for c in RATES], (F.col("quality") < 1).alias("bad"), "prune")
    kept = kept.orderBy(F.xxhash64("doc_id"), *kept.columns).limit(fit_rows).toArrow()  # fit_rows rows at the most, a dozen numbers each
    if not kept.num_rows:
        return []
    rates = np.column_stack([kept.column(c).to_numpy() for c in RATES])
    return learn(rates, kept.column("bad").to_numpy(), kept.column("prune").to_numpy())


def first_rule(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that a document meets, as one ordered conditional expression over RATES; 0 if it meets none."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(F.expr(rule.sql()), k).otherwise(out)
    return out


def verdicts(docs: DataFrame, labels: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule.

    rule is the number of the learned rule that rejects a document, 0 if none does; kept is false for those and
    for documents that fail the base rules. Null and empty texts have no word and fail. Repeated rows, also without doc_id, give a row each; an empty table gives an empty one; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.keep(statistics(docs), "stats")
    rules = fit(stats, labels) if rules is None else rules
    told = with_rates(stats).withColumns({"base_failed": base_failed(), "rule": first_rule(rules)})
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")


by_value(__name__)
