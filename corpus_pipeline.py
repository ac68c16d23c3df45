"""Clean and pack a corpus: quality, exact copies, near copies, benchmark passages, packing.

``STAGES`` lists the stages in order; each takes (spark, docs, folder) and returns a DataFrame
that is written as Parquet and read again as the next stage's documents. All but the last return
the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscope.llm import decontaminate, exact_dedup, ngram_join, packing, quality
from corpuscope.llm.common import fold, hold, release, table


def good_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the ranking puts at or above its cut; it learns from labels of folds 1 to 4 of 5."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, folder, "labels"), fold(F.col("doc_id"), 5) != 0))


def exact_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each text, the one with the smallest id."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group that is linked by Jaccard similarity, the one with the smallest id."""
    return ngram_join.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in which no passage of the benchmark is found."""
    return decontaminate.without_passages(docs, table(spark, folder, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents and where they lie in sequences of 2048 tokens."""
    return packing.pack(docs, find_added=True)


STAGES = [("quality classifier", good_quality), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies),
          ("benchmark decontamination", benchmark_passages), ("packing", pieces)]

#: The learned and the tokenising stage have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            out, before = hold(out), docs
            release(before)  # only what an earlier stage wrote is deleted
        docs = out
    return docs
