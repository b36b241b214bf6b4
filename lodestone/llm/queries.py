"""Queries of the corpus operators over their whole tables; where SQL can't express one, tests hold it against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread
from . import debruijn, embedding_dedup, fill_in_middle, language, packing, pieces, pii, quality, resampling, simhash, substring_dedup, token_files, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_documents(spark, sf_dir))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(_documents(spark, sf_dir))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.digests(table(spark, sf_dir, "documents"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op 9 that SQL can say."""
    return op9_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op 6 that SQL can say."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_pieces": op2_pieces,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_files": op4_token_files,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_language": op7_language,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_resampling": op12_resampling,
    "op13_debruijn_dedup": op13_debruijn_dedup,
    "quality_base": quality_base,
    "pii_base": pii_base,
}
ORACLES: dict[str, str] = {"op3_substring_dedup": substring_dedup.SQL, "op8_embedding_dedup": embedding_dedup.SQL, "op11_fill_in_middle": fill_in_middle.SQL, "op12_resampling": resampling.SQL, "op13_debruijn_dedup": debruijn.SQL, "quality_base": quality.BASE_SQL, "pii_base": pii.BASE_SQL}
