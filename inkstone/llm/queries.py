"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, funnels, hmm, licenses, merkle, minhash, packing, pii, quality, sentencepiece_codec, suffix, token_counts, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def piece_model() -> str:
    """The tokenizer's file; INKSTONE_PIECES names another one."""
    if path := os.environ.get("INKSTONE_PIECES"):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_model() -> str:
    """The word tokenizer's file; INKSTONE_WORDS names another one."""
    if path := os.environ.get("INKSTONE_WORDS"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), piece_model(), with_ids=False)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents")).drop("version")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), piece_model())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("version")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = pii.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(hmm.fit(table(spark, sf_dir, "documents")))


#: The funnels of the shop's clicks.
FUNNELS = (
    funnels.Funnel("A", ("view", "click", "view", "purchase"), ("error",)),
    funnels.Funnel("B", ("signup", "view", "click", "purchase"), ("error",)),
    funnels.Funnel("C", ("click", "click", "purchase", "view"), ("signup",)),
)


def op11_ordered_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnels.count(table(spark, sf_dir, "clicks"), FUNNELS)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_model())


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.spoiled(docs))


def queries() -> dict[str, Query]:
    own = (op1_license_scan, op2_sentencepiece, op3_decontamination, op4_minhash_groups, op5_token_counts, op6_toxicity, op7_quality_rules, op8_personal_data, op9_suffix_dedup, op10_hidden_markov, op11_ordered_funnels, op12_best_fit_packing, op13_merkle_manifest)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.oracle(), "op7_quality_rules": quality.ORACLE, "op11_ordered_funnels": funnels.oracle(FUNNELS), "op13_merkle_manifest": merkle.oracle()}
