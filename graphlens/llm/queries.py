"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphlens.llm import bpe, decontam, exact_dedup, langid, licences, ngram_join, quality, quotes, substrings, token_store
from graphlens.llm.shared import table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_texts(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_texts(spark, sf_dir), licences.known_licences(spark))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(_texts(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_texts(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_texts(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_texts(spark, sf_dir))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(_texts(spark, sf_dir))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(_texts(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_licences, op3_language_id, op4_substring_dedup, op5_bpe, op6_quality, op7_quotes, op8_exact_dedup, op9_ngram_jaccard, op10_token_store)
}

#: The others have no SQL form: tests hold them against brute force, an exact round trip or held-out accuracy.
ORACLE_SQL = {"op1_decontamination": decontam.ORACLE, "op2_licences": licences.oracle(), "op8_exact_dedup": exact_dedup.ORACLE}
