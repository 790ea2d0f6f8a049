"""From raw documents to token ids: five of the corpus operators, each on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sightline.llm import bpe, exact_dedup, minhash_dedup, mixing, toxicity
from sightline.llm.common import Scratch, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labels, does not reject; null and empty texts are clean, labels that are null or of no document are ignored."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The owner of each text without white space: one row, also where rows are equal; null texts count as empty."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component; texts without words have no partner. A doc_id with several texts has a fate for each."""
    return minhash_dedup.kept_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights ask for, from none to three times; a missing source is one of its own and comes last."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with the digests of ids and of the text decoded from them; a null text has none."""
    return bpe.encode_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: A fitted model, a similarity join and byte-pair merges have no SQL; tests/llm hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over documents; what goes from stage to stage is written as Parquet and read again. An empty table gives an empty result; columns besides doc_id, text and source pass through untouched."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
