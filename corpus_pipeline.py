"""A training corpus from ``documents``: language, near copies, benchmark leaks, personal data, mix.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame, which is written as Parquet in
the shared folder and read back as the next stage's ``docs``. All stages but the last return
the columns of ``documents``; the last adds the mix's word counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contestry.llm import decontaminate, jaccard_join, language, mixing, pii
from contestry.llm.common import held_out, staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the others; texts without a letter and
    texts that no learned language explains go."""
    return language.accepted(docs, language.fit_languages(docs.filter(~held_out(5, 0))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar texts: the one with the least id."""
    return jaccard_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redacted(docs, pii.fit_trees(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which the mix takes words, and how many of them."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_leaks),
    ("personal_data", redact_personal_data),
    ("mix", mix_sources),
]

#: The first, second and fourth stage rest on learned models and MinHash; no SQL gives their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs)
    return docs
