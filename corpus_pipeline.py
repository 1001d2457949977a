"""A training-data pipeline: documents pass from stage to stage as Parquet tables in the shared folder.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and columns of any name; all but the last keep the
columns of documents. What becomes of such rows is said at each stage; the operators' modules say more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from tonefold.llm import bpe, decon, lines, ngram, quality
from tonefold.llm.common import Scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-labelling field rejects go. A null text is scored as an empty line; rows that repeat fare alike; a score at the limit stays."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that come again go, and with them documents of which no line with words is left. Of equal lines the first by doc_id and place stays (rows
    without a doc_id come first); documents that had no words, null and empty ones among them, stay as they are; rows that repeat stay."""
    return lines.strip(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, Jaccard of 0.8 or more): that with the smallest doc_id. Documents without
    words and rows without a doc_id stay; rows that repeat a doc_id stay or go together."""
    return ngram.keep_first(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which ten words of a benchmark item (or a shorter item) stand in a row go. Documents without words stay; items without words or
    without an item_id do no harm; rows that repeat fare alike."""
    return decon.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, of every row; a null text counts as empty."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", good_documents), ("line_dedup", distinct_lines), ("ngram_join", near_copies), ("decontamination", clean_of_benchmarks), ("bpe", tokens)]

#: Not expressible in SQL (a trained classifier, a tokenizer); tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
