"""From raw documents to packed training sequences: language ID, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. Rows that share a doc_id are one document and stay or go together; rows without one
are never near-duplicates of anything."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, table, with_ids
from larkspur.llm.langid import identify, train_dictionaries
from larkspur.llm.minhash import minhash_near_duplicates
from larkspur.llm.packing import pack_documents
from larkspur.llm.quality import quality_filter


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; learned from those whose language is stated."""
    found = identify(docs, train_dictionaries(docs.select("doc_id", "text", "lang")))
    return found.where("not language.rejected").select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the risk-controlled rules keep."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    found = minhash_near_duplicates(docs, shingle=5, percent=80).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    gone = Scratch(spark, "gone").table(found.where("not kept").select("doc_id"), "ids")
    return with_ids(docs, gone, "doc_id", "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 2048."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, capacity=2048, end_id=0)


STAGES = [("language_id", language), ("quality_rules", quality), ("minhash_near_dedup", near_duplicates), ("best_fit_packing", packing)]

#: SQL expresses neither the language model nor the packing; a brute-force version is in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
