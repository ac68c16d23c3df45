"""Modules: top-level directories, their normal form and the structure check.

Files and chunks of a module are rows (``module_files``), because a module may hold any
number of them; the module tables carry counts.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import top_dir
from ..functions.text import contains_any, module_snake, uuid5
from ..rules.packs import CORE_MODULE_WORDS, MODULE_NOISE


def module_files(chunks: DataFrame) -> DataFrame:
    """Distinct (repo, module, path)."""
    return chunks.select("repo", top_dir(F.col("path")).alias("module"), "path").distinct()


def modules(chunks: DataFrame) -> DataFrame:
    """Files and chunks per module. Chunk counts are summed per file first."""
    per_file = chunks.groupBy("repo", "path").agg(F.count("*").alias("chunks"))
    return (per_file.groupBy("repo", top_dir(F.col("path")).alias("module"))
            .agg(F.count("*").alias("n_files"), F.sum("chunks").alias("n_chunks")))


def normal_names(members: DataFrame) -> DataFrame:
    """Rows of modules that are not noise, with the snake form of the module as ``name``."""
    kept = members.filter(~F.col("module").isin(MODULE_NOISE) & ~F.col("module").startswith("."))
    return kept.withColumn("name", module_snake(F.col("module")))


def normal_module_files(members: DataFrame) -> DataFrame:
    """(repo, name, path) without noise modules; modules with the same snake name meet.

    A path lies in one module, so distinct members stay distinct.
    """
    return normal_names(members).select("repo", "name", "path")


def normalize_modules(members: DataFrame) -> DataFrame:
    """One row per normalized module: UUIDv5 id, name, files, confidence 1.0."""
    return (normal_module_files(members).groupBy("repo", "name").agg(F.count("*").alias("n_files"))
            .select("repo", uuid5(F.col("name")).alias("module_id"), "name", "n_files", F.lit(1.0).alias("confidence")))


def is_core(name):
    return contains_any(name, CORE_MODULE_WORDS)


def validate_modules(modules_norm: DataFrame, repos: DataFrame) -> DataFrame:
    """E5: score, verdict and number of issues per repository in ``repos``."""
    stats = modules_norm.groupBy("repo").agg(
        F.count("*").alias("n"), F.count_if(F.col("n_files") == 0).alias("empty"),
        F.count_if(F.col("confidence") < 0.5).alias("low"), F.bool_or(is_core(F.col("name"))).alias("core"))
    out = repos.select("repo").distinct().join(stats, "repo", "left").na.fill(0, ["n", "empty", "low"]) \
        .withColumn("core", F.coalesce("core", F.lit(False)))
    points = F.greatest(F.lit(0), 100 - 10 * F.col("empty") - 10 * F.col("low") - F.when(F.col("core"), 0).otherwise(30))
    score = F.when(F.col("n") == 0, 0).otherwise(points)
    issues = F.when(F.col("n") == 0, 1).otherwise(F.col("empty") + F.col("low") + F.when(F.col("core"), 0).otherwise(1))
    return out.select("repo", (score / 100).alias("score"), ((score >= 70) & F.col("core")).alias("valid"),
                      issues.cast("long").alias("n_issues"))


def validation_issues(modules_norm: DataFrame, repos: DataFrame) -> DataFrame:
    """E5: the issues as rows."""
    name = F.col("name")
    own = modules_norm.select("repo", F.explode(F.array_compact(F.array(
        F.when(F.col("n_files") == 0, F.concat(F.lit("Empty module: "), name)),
        F.when(F.col("confidence") < 0.5, F.concat(F.lit("Low confidence ("), F.col("confidence").cast("string"), F.lit(") for module: "), name)))))
        .alias("issue"))
    stats = modules_norm.groupBy("repo").agg(F.bool_or(is_core(name)).alias("core"))
    whole = repos.select("repo").distinct().join(stats, "repo", "left").select("repo", F.when(
        F.col("core").isNull(), "No modules found in the context.").when(
        ~F.col("core"), "Missing core application structure (e.g., no module named src, app, lib, backend, or frontend).").alias("issue"))
    return own.unionByName(whole.filter("issue is not null"))


def payload_files(scan: DataFrame, classified: DataFrame) -> DataFrame:
    """The per-file part of the final record (joined, with defaults)."""
    from .classify import join_classified
    return join_classified(scan, classified)


def final_payload(files: DataFrame, chunks: DataFrame, modules_norm: DataFrame, validation: DataFrame) -> DataFrame:
    """One summary row per repository; files, chunks and modules stay tables of their own."""
    per = lambda df, name: df.groupBy("repo").agg(F.count("*").alias(name))
    sizes = files.groupBy("repo").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"),
                                      F.count_if(F.col("category") == "unknown").alias("n_unknown"))
    return (sizes.join(per(chunks, "n_chunks"), "repo", "left").join(per(modules_norm, "n_modules"), "repo", "left")
            .join(validation, "repo", "left").na.fill(0, ["n_chunks", "n_modules"]))


def payload_json(files: DataFrame) -> DataFrame:
    """Every file record as a JSON line, for writers."""
    return files.select("repo", F.to_json(F.struct("path", "ext", "size", "category", "confidence")).alias("record"))
