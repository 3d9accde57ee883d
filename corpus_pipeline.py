"""The corpus pipeline: language ID, near-dedup, mixing, packing; each stage reads what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from huntframe.llm.common import cut, small_batches, table
from huntframe.llm.op4_language_id import keep_identified, learn
from huntframe.llm.op5_source_mixing import apply_mix
from huntframe.llm.op9_minhash_dedup import deduplicate
from huntframe.llm.op10_best_fit_packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows of docs teach; others go. Same columns.

    Null and empty texts, texts without a letter and scripts never seen go. Repeated rows and rows of one or of no
    doc_id are judged one by one. No labelled rows teach nothing: all go. No rows: no rows.
    """
    small_batches(spark)
    return keep_identified(docs, learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), the one of smallest doc_id. Same columns.

    Texts without a word are no duplicates of each other. Repeated rows of a doc_id become one; rows without a doc_id stay.
    """
    small_batches(spark)
    return deduplicate(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: rows repeat, or go. Same columns. Texts without a word weigh nothing; a null source is a source of its own."""
    return apply_mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row in sequences of at most 2048 tokens: one row per piece. Rows that the mix repeated are packed one by one; null text is the end token alone."""
    small_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses neither cross-parsing nor the packing search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = cut(docs)
    return docs
