"""The registered queries of this subpackage and their DuckDB statements."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuscope.llm import decontaminate, hmm, langid, licenses, linear_grouping, manifest, ngram_join, quality, suffix_dedup, toxicity, whitening
from corpuscope.llm.common import fold, table
from corpuscope.llm.exact_dedup import exact_dedup
from corpuscope.llm.packing import pack

def _learn() -> Column:
    return fold(F.col("doc_id"), 5) != 0


def _classified(scored: DataFrame, cut: float) -> DataFrame:
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(toxicity.labelled_sample(docs, table(spark, folder, "labels"), "toxic", _learn()))
    return _classified(toxicity.score(docs, model), 0.5)


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.learn(docs, table(spark, folder, "labels"), _learn())
    return _classified(quality.score(docs, model), quality.CUT_SCORE)


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


def op4_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.score_documents(table(spark, folder, "documents"))


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, folder, "documents"))


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.train(docs, fold(F.col("doc_id"), 4) != 2)
    return langid.predict(docs, model).withColumn("held_out", fold(F.col("doc_id"), 4) == 2)


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), find_added=True)


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document and item found in it; clean documents have none."""
    return decontaminate.find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document and license whose notice is found in it."""
    return licenses.find_notices(table(spark, folder, "documents"))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Four rows for each usable vector; a deviation beyond a long is null here."""
    return whitening.whiten(table(spark, folder, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.digest_table(table(spark, folder, "documents"))


def op13_linear_grouping(spark: SparkSession, folder: str) -> DataFrame:
    return linear_grouping.pack_grouped(table(spark, folder, "documents"), find_added=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_model": op4_language_model,
    "op5_ngram_join": op5_ngram_join,
    "op6_language": op6_language,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_licenses": op9_licenses,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_whitening": op11_whitening,
    "op12_manifest": op12_manifest,
    "op13_linear_grouping": op13_linear_grouping,
}

SQL: dict[str, str] = {
    "op9_licenses": licenses.duckdb_sql(),
    "op3_exact_dedup": r"""
WITH keyed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
grouped AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM keyed GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM keyed JOIN grouped USING (text_sha256)""",
}
