"""A corpus from raw documents to token ids, in stages that each work on what the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns the rows of ``docs`` that stay, with the columns of documents; the
last one returns the encoded documents.  ``run`` writes each stage as Parquet in the shared folder and reads it again.

Defined cases of every stage: null texts count as empty, texts of any length are read whole, rows with a null id are
judged by their texts like others, an empty table gives no rows, and extra columns stay with their rows whatever their
names (the last stage gives its own columns only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphlens.llm import bpe, decontam, exact_dedup, ngram_join, quality
from graphlens.llm.shared import new_path, removed_path, scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    Empty texts have the score of the model's bias; without labels of both kinds all texts have one score, the share of
    good labels; rows that repeat an id are scored each by its own text.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts.

    The longest original stays, then the smallest id (null last); of rows that repeat both one stays, whichever; empty
    and blank texts are equal to each other.
    """
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    The smallest id stays (null last), then the least hash of its text; of rows that repeat both one stays; texts without
    words are near nothing and all stay.
    """
    return ngram_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item.

    Items without words, or none at all, take nothing out; texts without words stay; rows that repeat id and text stay or
    go together.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, a row for each row of ``docs``; empty texts have no ids."""
    return bpe.round_trip(docs.select("doc_id", "text"))


STAGES = [("quality", good_quality), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("decontamination", without_benchmark), ("bpe", encoded)]

#: The classifier and the encoder have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote for itself, and its input, go as soon as its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            removed_path(spark, before)
        before = path
    return docs
