"""Learning unknown file extensions: find them, infer a language, keep what is sure."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..rules.languages import REGISTRY, Registry
from ..rules.packs import LANGUAGE_TOKENS
from .chunks import snippet_of

SCORED = "ext string, language string, role string, confidence double, evidence string"


def representative_per_ext(classified: DataFrame) -> DataFrame:
    """the first unclassified file of every extension of a repository."""
    unknown = classified.filter("category = 'unknown' and ext <> ''")
    return unknown.groupBy("repo", "ext").agg(F.min("path").alias("path"), F.min_by("content", "path").alias("content"))


def drop_known(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Without the extensions that are cached already."""
    return files.join(cache.select("ext").distinct(), "ext", "left_anti")


def unknown_extensions(classified: DataFrame, cache: DataFrame, limit: int = 800) -> DataFrame:
    """One readable snippet per repository and extension that nobody knows.

    Known extensions go last, from a row per repository and extension: a join of the files
    themselves would send all contents of an extension to one task.
    """
    starts = classified.withColumn("content", F.substring("content", 1, limit))
    return snippet_of(drop_known(representative_per_ext(starts), cache), limit)


def infer_languages(snippets: DataFrame, rules=LANGUAGE_TOKENS, scorer=None) -> DataFrame:
    """(ext, language, role, confidence, evidence) of the best token rule per extension.

    ``scorer`` may replace the rules: a function from an iterator of pandas frames with repo,
    path, ext and snippet to frames with the output columns, run with ``mapInPandas``.
    """
    if scorer is not None:
        scored = snippets.mapInPandas(scorer, SCORED)
    else:
        hits = F.array_compact(F.array(*[
            F.when(F.col("snippet").rlike(rx), F.struct(F.lit(language).alias("language"), F.lit(role).alias("role"),
                                                        F.lit(conf).alias("conf"), F.trim(F.regexp_extract("snippet", f"({rx})", 1)).alias("evidence"), F.lit(i).alias("ord")))
            for i, (rx, language, role, conf) in enumerate(rules)]))
        scored = snippets.select("ext", F.explode(hits).alias("h")).select("ext", "h.language", "h.role", (F.col("h.conf") / 100).alias("confidence"), "h.evidence")
    best = F.struct("confidence", "language", "role", "evidence")
    return scored.groupBy("ext").agg(F.max(best).alias("b")).select("ext", "b.language", "b.role", "b.confidence", "b.evidence")


def accept_inferences(scored: DataFrame, floor: float = 0.7) -> DataFrame:
    """Sure and named languages only; an unknown role becomes backend."""
    language = F.trim(F.coalesce("language", F.lit("")))
    role = F.trim(F.coalesce("role", F.lit("backend")))
    return (scored.filter((F.col("ext") != "") & ~F.lower(language).isin("", "unknown") & (F.col("confidence") >= floor))
            .select(F.lower("ext").alias("ext"), language.alias("language"),
                    F.when(role.isin("backend", "frontend", "config", "docs"), role).otherwise("backend").alias("role"),
                    F.round("confidence", 4).alias("confidence"), "evidence"))


def upsert_inferences(cache: DataFrame, accepted: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """The cache plus new extensions. Cached and curated extensions are never touched.

    The result is a new table; write it as a new version next to the old one.
    """
    curated = [e for e, _, _, tier in registry.lang_ext if tier == "curated"]
    fresh = accepted.filter(~F.col("ext").isin(curated)).join(cache.select("ext"), "ext", "left_anti")
    return cache.select("ext", "language", "role", "confidence").unionByName(fresh.select("ext", "language", "role", "confidence"))
