"""Operator 1: toxicity by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import Scratch, by_value, slices, text_or_empty

#: Labelled rows that a model is fitted on at the most: those with the smallest hash of doc_id, then of the text. The only bound here; every document is scored.
FIT_ROWS = 20_000
#: Features kept by the fit, of those found in at least SUPPORT fitted documents.
FEATURES, SUPPORT = 4096, 5
#: A document is rejected from this probability of any toxicity on.
LIMIT = 0.5
#: Grades: 0 for clean, 1 to LEVELS - 1 for toxic documents.
LEVELS = 4
#: A feature counts towards the grade of a fitted document from this log-odds on.
MARKER = 2.0
PREFIXES = (3, 4, 5, 6)
RIDGE, STEPS, RATE = 5e-5, 600, 0.08
#: Distinct words remembered by a task before it starts anew, and documents read at a time.
MEMO, ROWS = 100_000, 250
WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Hashes of a lower-case word and of its beginnings, which its inflections share."""
    return [xxhash.xxh3_64_intdigest("=" + word) >> 1, *(xxhash.xxh3_64_intdigest(f"{n}^" + word[:n]) >> 1 for n in PREFIXES if len(word) > n)]


def distinct_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(cuts[k] - score), the score being the sum of the weights of the features present.

    One weight per feature serves all thresholds; the cuts ascend.
    """

    weights: dict[int, float] = field(default_factory=dict)
    cuts: list[float] = field(default_factory=lambda: [30.0, 31.0, 32.0])

    def expected(self, score: float) -> tuple[float, float, int]:
        """Expected grade, probability of any toxicity, and the median grade: the highest that is reached with probability LIMIT."""
        above = [1 / (1 + math.exp(min(700.0, c - score))) for c in self.cuts]
        return sum(above), above[0], sum(a >= LIMIT for a in above)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, width: int, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts that maximise the ridge-penalised likelihood of a 0/1 matrix in coordinates."""
    n = len(grades)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=levels))[:-1] / max(n, 1), 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + np.arange(levels - 1) * 1e-3)
    params = np.concatenate((np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    m, v = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda x: 0.5 * (1 + np.tanh(0.5 * x))
    for step in range(1, STEPS + 1):
        w, first, gaps = params[:width], params[width], np.exp(params[width + 1 :])
        cuts = np.concatenate(([-np.inf], first + np.concatenate(([0.0], np.cumsum(gaps))), [np.inf]))
        score = np.bincount(rows, weights=w[cols], minlength=n)  # one float for each feature of a document
        hi, lo = sigmoid(cuts[grades + 1] - score), sigmoid(cuts[grades] - score)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        grad_w = np.bincount(cols, weights=(dhi - dlo)[rows], minlength=width) / n + RIDGE * w
        per_cut = np.array([-(dhi[grades == k].sum() - dlo[grades == k + 1].sum()) / n for k in range(levels - 1)])
        tail = np.cumsum(per_cut[::-1])[::-1]
        grad = np.concatenate((grad_w, tail[:1], tail[1:] * gaps))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:width], params[width] + np.concatenate(([0.0], np.cumsum(np.exp(params[width + 1 :]))))


def _feature_batches(batches):
    memo: dict[str, list[int]] = {}
    for batch in slices(batches, ROWS):
        out = []
        for text in batch.column(2).to_pylist():
            if len(memo) > MEMO:
                memo.clear()
            found: set[int] = set()
            for w in distinct_words(text):
                f = memo.get(w)
                if f is None:
                    f = memo[w] = word_features(w)
                found.update(f)
            out.append(sorted(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "toxic", "body", "features"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """A model from labels (doc_id, toxic of 0 or 1), or (doc_id, grade of 0 to LEVELS - 1) where there is such a column.

    With 0/1 labels alone, a toxic document's grade is the third of the toxic
    documents that it falls in by its number of marked features. Those of one half of the documents (by hash) are marked by the other half's labels, so no label
    or text takes part in its own grade. Features are chosen by the likelihood-ratio statistic of presence against the label. Labels that are null
    or of no document are ignored; of repeated ones the highest holds; of rows that share a doc_id each counts. Without two classes the model calls everything clean.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    target = "grade" if "grade" in labels.columns else "toxic"
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text", F.xxhash64("text").alias("body"))
    found = scratch.keep(texts.mapInArrow(_feature_batches, "doc_id long, toxic int, body long, features array<long>").withColumn("row", F.monotonically_increasing_id()), "found")
    # a doc_id can have many rows, so the rows are bounded once more; without their features, as they meet in one task
    order = (F.xxhash64("doc_id"), "doc_id", "body", "row")
    some = found.select("doc_id", "body", "row").orderBy(*order).limit(fit_rows).select("row")
    rows = scratch.keep(found.join(F.broadcast(some), "row"), "features")
    scratch.drop(found)
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int")
    sizes = {(r.half, r.bad): r.n for r in rows.groupBy(half.alias("half"), (F.col("toxic") > 0).alias("bad")).agg(F.count("*").alias("n")).collect()}
    n = {(f, bad): sizes.get((f, bad), 0) for f in (0, 1) for bad in (False, True)}
    positive = n[0, True] + n[1, True]
    total = sum(n.values())
    if not positive or positive == total:
        return OrdinalModel()
    bad = lambda f: F.count_if((F.col("toxic") > 0) & (half == f))
    good = lambda f: F.count_if((F.col("toxic") <= 0) & (half == f))
    counts = rows.select("doc_id", "toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("all"), *(x(f).alias(f"{c}{f}") for c, x in (("bad", bad), ("good", good)) for f in (0, 1))).where(F.col("all") >= SUPPORT)
    a, b = (F.col("bad0") + F.col("bad1")).cast("double"), (F.col("good0") + F.col("good1")).cast("double")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    rate = positive / total
    g2 = part(a, F.col("all") * rate) + part(b, F.col("all") * (1 - rate)) + part(positive - a, (total - F.col("all")) * rate) + part((total - positive) - b, (total - F.col("all")) * (1 - rate))

    def marks(f: int):
        x, y = F.col(f"bad{f}"), F.col(f"good{f}")
        return F.log((x + 0.5) / (n[f, True] - x + 0.5)) - F.log((y + 0.5) / (n[f, False] - y + 0.5)) >= MARKER

    best = counts.select("feature", g2.alias("g2"), marks(0).alias("mark0"), marks(1).alias("mark1")).orderBy(F.desc("g2"), "feature").limit(FEATURES).collect()  # FEATURES rows at the most
    # from rows Spark would start a second set of Python workers for an RDD, which stay for the stages that follow; from Arrow it starts none
    marked = pa.table([[r.feature for r in best], range(len(best)), [r.mark0 for r in best], [r.mark1 for r in best]], schema=pa.schema([("feature", pa.int64()), ("k", pa.int32()), ("mark0", pa.bool_()), ("mark1", pa.bool_())]))
    index = docs.sparkSession.createDataFrame(marked)
    found = rows.select("row", F.explode("features").alias("feature")).join(F.broadcast(index), "feature")
    found = found.groupBy("row").agg(F.sort_array(F.collect_set("k")).alias("ks"), F.count_if(F.col("mark0")).alias("m0"), F.count_if(F.col("mark1")).alias("m1"))
    fitted = rows.drop("features").join(found, "row", "left").select("doc_id", "body", "row", "toxic", F.coalesce("ks", F.array().cast("array<int>")).alias("ks"), F.coalesce(F.when(half == 0, F.col("m1")).otherwise(F.col("m0")), F.lit(0)).cast("int").alias("marks"))
    sparse = fitted.orderBy("doc_id", "body", "row").drop("doc_id", "body", "row").toArrow()  # fit_rows rows at the most, packed: four bytes for each feature of a document
    scratch.drop(rows)
    toxic, marked = sparse.column("toxic").to_numpy(), sparse.column("marks").to_numpy()
    lists = sparse.column("ks").combine_chunks()
    at = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    cols = lists.flatten().to_numpy().astype(np.int32, copy=False)
    del sparse, lists
    if target == "grade":
        grades = np.clip(toxic, 0, LEVELS - 1)
    else:
        edges = np.quantile(marked[toxic > 0], np.arange(1, LEVELS - 1) / (LEVELS - 1))
        grades = np.where(toxic > 0, 1 + np.searchsorted(edges, marked, side="left"), 0)
    weights, cuts = fit_ordinal(at, cols, grades, len(best))
    return OrdinalModel({r.feature: round(float(weights[k]), 6) for k, r in enumerate(best)}, [round(float(c), 6) for c in cuts])


def scorer(model: OrdinalModel):
    """Function from a text to its score, with a memo of the words seen."""
    weights, memo = model.weights, {}

    def look(word):
        if len(memo) > MEMO:
            memo.clear()
        found = memo[word] = tuple(f for f in word_features(word) if f in weights)
        return found

    def score(text: str) -> float:
        hits: set[int] = set()
        for w in distinct_words(text):
            f = memo.get(w)
            if f is None:
                f = look(w)
            if f:
                hits.update(f)
        return math.fsum(weights[f] for f in hits)

    return score


def _score_batches(model: OrdinalModel, limit: float):
    def run(batches):
        score = scorer(model)
        for batch in slices(batches, ROWS):
            got = [(s, *model.expected(s)) for s in map(score, batch.column(1).to_pylist())]
            cols = [[round(g[0], 6) for g in got], [round(g[1], 6) for g in got], [round(g[2], 6) for g in got], [g[3] for g in got], [g[2] >= limit for g in got]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.bool_()), strict=True))], ["doc_id", "score", "expected_severity", "p_toxic", "grade", "toxic"])

    return run


def _clean_batches(model: OrdinalModel, limit: float, at: int):
    def run(batches):
        score = scorer(model)
        for batch in slices(batches, ROWS):
            keep = [model.expected(score(t or ""))[1] < limit for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def severities(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, model: OrdinalModel | None = None) -> DataFrame:
    """One row per document: doc_id, score, expected_severity (0 to LEVELS - 1), p_toxic, grade (the median), toxic.

    Whole texts are scored; null text counts as empty and gets the score 0, as does
    a text without known features. Repeated rows give a row each. An empty table gives an empty one; other columns are ignored.
    """
    model = model or fit(docs, labels)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_score_batches(model, limit), "doc_id long, score double, expected_severity double, p_toxic double, grade int, toxic boolean")


def clean_documents(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, model: OrdinalModel | None = None) -> DataFrame:
    """The rows of docs, whole, that are not toxic.

    Null and empty texts are clean, as is every row where the labels lack a class;
    equal texts stay or go together, whatever their doc_id. An empty table gives an empty one; other columns may have any names.
    """
    model = model or fit(docs, labels)
    return docs.mapInArrow(_clean_batches(model, limit, docs.columns.index("text")), docs.schema)


by_value(__name__)
