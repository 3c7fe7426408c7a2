"""A corpus pipeline over ``documents``: language, near duplicates, benchmark passages, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``. What they do:

1. language: rows whose text is of no known language go.
2. near_duplicates: one row of each group of near duplicates stays, that with the least doc_id.
3. decontamination: documents that hold a benchmark item go.
4. secrets: documents that hold a secret go; those whose only finding is a hexadecimal run without both digits
   and letters, which op9_secrets reports, stay.
5. mixing: sources are mixed to target weights; the result has ``copies``, how often a row is taken.

Null texts count as empty, which stage 1 drops, as it does texts without letters; null ids, sources and languages
are values like others. Rows that share an id are told apart by their texts, and equal rows are near duplicates. Of
ties in a group of near duplicates the least text digest stays. Very long texts are read whole. Extra columns are
kept, but for ``copies``, which gives way to the last stage's. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import decontaminate, language, mixing, secrets, simhash
from weft.llm.common import fresh_path, remove, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("secrets", drop_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes once the next one is written; the last one stays, as the result reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


#: Language ID, components and latent semantic retrieval aren't expressed in SQL; see tests/llm.
ORACLE_SQL = None
