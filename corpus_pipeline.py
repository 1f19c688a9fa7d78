"""Corpus pipeline over `documents`: STAGES of (name, function), run() and ORACLE_SQL.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm.decontaminate import clean
from loomspark.llm.mixing import mixed_documents
from loomspark.llm.near_copies import near_groups
from loomspark.llm.quality import keep_good
from loomspark.llm.simhash import joined_groups, keep_one, simhash_groups
from loomspark.llm.tokens import token_documents
from loomspark.session import materialize, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: those that SimHash links, and those whose five-word shingles have a Jaccard
    similarity of 0.8 or more, directly or through others of either kind."""
    return keep_one(docs, joined_groups(simhash_groups, near_groups))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, per document and pass over its source."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Arrow token files; returns doc_id, start, n_tokens and ids_crc32 as read back from them."""
    return token_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mixture", mixture), ("token_files", token_files)]
#: SQL expresses neither the classifier nor the draws; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
