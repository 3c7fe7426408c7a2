"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.llm import decontaminate, fingerprint, language, licenses, mixing, pii, secrets, simhash, tokens, url_filter
from weft.llm.common import cut, fresh_path, remove, table

DEFAULT_TOKENIZER = "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """A cold run: the cache is new, so every distinct text is encoded. Its folder goes once the counts are kept."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path(DEFAULT_TOKENIZER)
    cache = fresh_path(spark, "token-cache")
    found = cut(tokens.count_tokens(table(spark, sf_dir, "documents"), str(model_path), cache))
    remove(spark, cache)
    return found


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.digest(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op3_fingerprints SQL can check."""
    return fingerprint.edited_texts(table(spark, sf_dir, "documents"))


def benchmark_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op6_decontamination SQL can check."""
    return decontaminate.benchmark_runs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op8_licenses SQL can check."""
    return licenses.phrases(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_personal_data": op2_personal_data,
    "op3_fingerprints": op3_fingerprints,
    "op4_mixing": op4_mixing,
    "op5_url_filter": op5_url_filter,
    "op6_decontamination": op6_decontamination,
    "op7_language": op7_language,
    "op8_licenses": op8_licenses,
    "op9_secrets": op9_secrets,
    "op10_simhash": op10_simhash,
    "edited_texts": edited_texts,
    "benchmark_runs": benchmark_runs,
    "license_phrases": license_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op2_personal_data": pii.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op5_url_filter": url_filter.ORACLE,
    "op9_secrets": secrets.ORACLE,
    "edited_texts": fingerprint.EDITED_ORACLE,
    "benchmark_runs": decontaminate.RUNS_ORACLE,
    "license_phrases": licenses.PHRASES_ORACLE,
}
