"""Operator 4: near-duplicate documents by circulant MinHash, banding and exact Jaccard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import Scratch, row_key, semi_join, text_or_empty, without_rows
from sightline.llm.neardup import class_components, link_classes, set_batches, signature_batches

#: A pair of similarity 0.85 shares no band with probability (1 - 0.85**5)**24 = 8e-7.
BANDS, ROWS = 24, 5
NUM, DEN = 85, 100


def _grouped(docs: DataFrame, num: int, den: int, bands: int, rows: int, scratch: Scratch) -> DataFrame:
    """(row, doc_id, n, owner) of each row of docs: owner is struct(missing, doc_id, row) of the row that its component keeps, null if it is alone."""
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    texts = texts.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "doc_id", "text")
    items = scratch.keep(texts.mapInArrow(signature_batches(bands, rows, 2), "row long, doc_id long, n long, fp binary, bands array<long>"), "items")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return semi_join(texts.select("row", "text"), wanted.select("row"), "row").mapInArrow(set_batches(1), "row long, fp binary, hashes array<long>")

    # a missing doc_id comes last
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    classes, linked = link_classes(items.where("n > 0").select("row", order.alias("order"), "n", "fp", "bands"), sets_of, num, den, scratch)
    return items.select("row", "doc_id", "n", "fp").join(class_components(classes, linked, scratch), "fp", "left").select("row", "doc_id", "n", "owner")


def near_duplicates(docs: DataFrame, num: int = NUM, den: int = DEN, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of other than white space, A-Z lower-cased; the set of a
    document is its distinct five-word shingles, or all its words as one shingle when they are fewer. Documents
    link when den * intersection >= num * union, confirmed on the full sets. component_id is the smallest doc_id
    reachable; kept marks that document.

    Null text counts as empty; a document without words has n_shingles 0, is linked with nothing and is kept. Repeated texts are one class,
    so thousands of copies cost as much as one. A repeated doc_id gives a row each, linked by its own text. A missing doc_id comes last: component_id is null only if no member has one. An empty table gives an empty one; other columns are ignored.
    """
    got = _grouped(docs, num, den, bands, rows, Scratch(docs.sparkSession, "near"))
    component = F.coalesce("owner.doc_id", "doc_id")
    return got.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def kept_documents(docs: DataFrame, num: int = NUM, den: int = DEN, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs, whole, that stay: of each component the row of the smallest doc_id (a missing one last; then one of its texts), and every row without a partner.

    Documents are told apart by doc_id and text, so a row stays although another
    with its doc_id goes; rows equal in both are one document and stay or go together. Null and empty texts have no partner. An empty table gives an empty one; other columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "near")
    got = _grouped(docs, num, den, bands, rows, scratch)
    gone = scratch.keep(got.where(F.col("owner").isNotNull() & (F.col("row") != F.col("owner.row"))).select("doc_id", "row").distinct(), "gone")
    return without_rows(docs, gone)
