"""The registered queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isoreach.llm import decontam, flac, langid, passages, pieces, quality, simhash, suffixes, tokens, warc

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op1_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op5_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.round_trip(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(_table(spark, sf_dir, "documents"))


def op10_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op1_simhash_decontamination"] = op1_simhash_decontamination
QUERIES["op3_suffix_dedup"] = op3_suffix_dedup
QUERIES["op9_substring_dedup"] = op9_substring_dedup
QUERIES["op4_sentencepiece"] = op4_sentencepiece
QUERIES["op6_token_counts"] = op6_token_counts
QUERIES["op5_flac_media"] = op5_flac_media
QUERIES["op7_language_id"] = op7_language_id
QUERIES["op10_quality_mil"] = op10_quality_mil
QUERIES["op2_simhash_near_dedup"] = op2_simhash_near_dedup
QUERIES["op8_warc"] = op8_warc
SQL["op8_warc"] = warc.SQL
