"""Registered queries of the corpus operators: each runs over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers

from sightline.llm import bpe, divergence, exact_dedup, merkle, minhash_dedup, mixing, oracle, paragraph_dedup, personal_data, quality_rules, secrets, token_files, toxicity, whitening
from sightline.llm.common import table


def _documents(apply):
    return lambda spark, sf_dir: apply(table(spark, sf_dir, "documents"))


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _toxicity(spark, sf_dir):
    return toxicity.severities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _quality(spark, sf_dir):
    return quality_rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _whitened(spark, sf_dir):
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_toxicity_severity": _toxicity,
    "op2_token_files": _documents(lambda docs: token_files.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))),
    "op3_merkle_fingerprints": _documents(merkle.fingerprints),
    "op4_minhash_near_duplicates": _documents(minhash_dedup.near_duplicates),
    "op5_paragraph_repeats": _documents(paragraph_dedup.repeats),
    "op6_exact_duplicates": _documents(exact_dedup.exact_duplicates),
    "op7_secret_spans": _documents(secrets.secret_spans),
    "op8_personal_data": _documents(personal_data.personal_spans),
    "op9_bpe_encode_decode": _documents(lambda docs: bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)),
    "op10_mix_sources": _documents(mixing.mix),
    "op11_whitened_embeddings": _whitened,
    "op12_source_divergence": _documents(divergence.source_divergence),
    "op13_quality_rules": _quality,
    "pipeline": _pipeline,
    # columns of op7, op8, op10, op11 and op13 that SQL can express
    "secret_base_spans": _documents(lambda docs: secrets.secret_spans(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")),
    "personal_base_spans": _documents(lambda docs: personal_data.personal_spans(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")),
    "mix_source_targets": _documents(lambda docs: mixing.mix(docs).select("doc_id", "size", "source_size", "target")),
    "embedding_deviations": lambda spark, sf_dir: _whitened(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation"),
    "quality_base_counts": lambda spark, sf_dir: _quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
}

ORACLE_SQL = oracle.SQL
