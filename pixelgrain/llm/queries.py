"""Queries over the driver's tables for the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, exact_dedup, lm_score, near_dup, pii, quality, suffix_dedup, toxicity, warc
from ._base import read_table

#: The key of the registered query; an installation passes its own.
PSEUDONYM_KEY = "corpus-key-1"

Query = Callable[[SparkSession, str], DataFrame]


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(read_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good."""
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.cross_entropy_difference(read_table(spark, sf_dir, "documents"), good)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(read_table(spark, sf_dir, "documents"), word_tokenizer_path()))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(read_table(spark, sf_dir, "pages")), "page_id")


def queries() -> dict[str, Query]:
    own = (op1_benchmark_decontamination, op2_minhash_near_dedup, op3_quality_classifier, op4_lm_scoring, op5_suffix_array_dedup)
    own += (op6_toxicity, op7_exact_dedup, op8_bpe, op9_pii, op10_warc)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": exact_dedup.ORACLE}
