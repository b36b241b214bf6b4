"""A corpus pipeline: language, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the
last return the columns of ``docs``; ``run`` writes each stage's rows to the shared folder and
reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import language, near_copies, packing, pii, substring_dedup
from lodestone.llm.common import discard, settled, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters or told with little confidence go."""
    return language.accepted(docs, language.learn(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles of Jaccard similarity 0.8 or more, verified exactly."""
    return near_copies.kept_documents(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that occur elsewhere too; documents stay, if need be empty."""
    return substring_dedup.cleaned(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; the workers also hold other stages' state, so the word memo is small."""
    return packing.pack(docs, memo=200_000)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("repeated_passages", without_repeats),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: SQL can't express the kernels, suffix arrays, field or tokenizer; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        # what the stage wrote on its way goes with it, and its input goes once nothing reads it
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
