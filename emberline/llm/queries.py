"""The registered queries of this package: name -> (spark, folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import decontaminate, lm, mixing, negatives, pii, quality, secrets, simhash, suffix_dedup, tokens, toxicity, warc, whitening
from emberline.llm.oracles import ORACLES
from emberline.sources.tables import table


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.removal_digest(table(spark, folder, "documents"))


def op2_private_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.private_data_digest(table(spark, folder, "documents"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_digest(table(spark, folder, "documents"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_digest(table(spark, folder, "documents"))


def op9_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.tokenize_digest(table(spark, folder, "documents"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination_digest(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates_digest(table(spark, folder, "documents"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_digest(table(spark, folder, "pages"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_digest(table(spark, folder, "documents"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.negatives_digest(table(spark, folder, "embeddings"))


def op13_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets_digest(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_private_data,
        op3_mixing,
        op4_simhash,
        op5_language_model,
        op6_quality,
        op7_warc,
        op8_toxicity,
        op9_tokens,
        op10_decontamination,
        op11_whitening,
        op12_hard_negatives,
        op13_secrets,
    )
}

__all__ = ["ORACLES", "QUERIES"]
