"""Languages, roles and categories of files, and the counts built on them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import basename, dirs, in_dirs
from ..functions.text import contains_any, lit_array
from ..rules import languages as L
from ..rules.languages import REGISTRY, Registry
from ..sources.registry import lang_ext


def with_language(df: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """Language of the extension, ``unknown`` where none is registered."""
    dim = F.broadcast(lang_ext(df.sparkSession, registry).select("ext", "language"))  # one row per extension
    return df.join(dim, "ext", "left").withColumn("language", F.coalesce("language", F.lit("unknown")))


def role_column(ext: Column, registry: Registry = REGISTRY) -> Column:
    """Config, docs and binary extensions first, then the role of the language."""
    out = (F.when(ext.isin(list(registry.config_exts)), "config")
           .when(ext.isin(list(registry.doc_exts)), "docs")
           .when(ext.isin(list(registry.binary_exts)), "binary"))
    for role in sorted({r for _, _, r, _ in registry.lang_ext}):
        out = out.when(ext.isin(registry.exts_with_role(role)), role)
    return out.otherwise("unknown")


def entry_point_column(name: Column, registry: Registry = REGISTRY) -> Column:
    """B4"""
    return F.lower(name).isin(list(registry.entry_points))


def build_file_column(name: Column, registry: Registry = REGISTRY) -> Column:
    """B5"""
    return F.lower(name).isin(list(registry.build_files))


def describe_ext(df: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """The registry record of every extension in ``df``; nulls when it is unknown."""
    dim = F.broadcast(lang_ext(df.sparkSession, registry))
    return df.select("ext").distinct().join(dim, "ext", "left")


def _category(path: Column, ext: Column, registry: Registry):
    """The ordered ladder of (condition, category, hundredths)."""
    name, lower = F.lower(basename(path)), F.lower(path)
    parts = F.split(lower, "/")
    among = lambda names: F.arrays_overlap(parts, lit_array(names))
    role = role_column(ext, registry)
    steps = [(entry_point_column(name, registry), "entry_point", 100),
             (role == "config", "config", 90),
             (contains_any(name, L.CONFIG_NAME_WORDS), "config", 80),
             (among(L.CONFIG_DIRS), "config", 70)]
    for category, folders, words in L.CATEGORY_LADDER:
        steps.append((among(folders), category, 90))
        if category == "component":
            steps.append((role == "frontend", category, 80))
        steps.append((contains_any(name, words), category, 80))
    return steps


def classify_files(df: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """Category and confidence of every file."""
    category = conf = None
    for cond, cat, hundredths in _category(F.col("path"), F.col("ext"), registry):
        category = F.when(cond, cat) if category is None else category.when(cond, cat)
        conf = F.when(cond, hundredths) if conf is None else conf.when(cond, hundredths)
    return df.withColumn("category", category.otherwise("unknown")) \
             .withColumn("confidence", conf.otherwise(0) / 100)


def structural_role(df: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """Distinct (repo, role, file name) of source files below role directories."""
    d = dirs(F.lower("path"))
    role = None
    for name, folders in L.STRUCTURE_DIRS.items():
        cond = F.size(F.array_intersect(d, lit_array(folders))) > 0
        role = F.when(cond, name) if role is None else role.when(cond, name)
    kept = df.filter(F.col("ext").isin(registry.source_exts) & ~F.col("ext").isin(list(registry.binary_exts))
                     & ~in_dirs(F.col("path"), L.STRUCTURE_SKIP_DIRS))
    return kept.select("repo", role.alias("role"), basename(F.col("path")).alias("name")) \
               .filter("role is not null").distinct()


def negative_path(path: Column) -> Column:
    """A path segment that starts like a test, mock, fixture or example."""
    return path.rlike(L.NEGATIVE_PATH)


def business_path(path: Column) -> Column:
    """B10"""
    return path.rlike(L.BUSINESS_PATH)


def category_counts(classified: DataFrame) -> DataFrame:
    """E1"""
    return classified.groupBy("repo", "category").agg(F.count("*").alias("n"))


def role_files(df: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """Every path with its role bucket. One row per file: the lists have no upper bound."""
    role = role_column(F.col("ext"), registry)
    bucket = F.when(role.isin("frontend", "backend", "config", "docs"), role).otherwise("unknown")
    return df.select("repo", bucket.alias("role"), "path")


def role_buckets(df: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """Files per role bucket, one row per repository."""
    roles = ["frontend", "backend", "config", "docs", "unknown"]
    return role_files(df, registry).groupBy("repo").pivot("role", roles).count().na.fill(0, roles)


def directory_rollup(df: DataFrame) -> DataFrame:
    """Files and bytes below every directory of every repository."""
    d = dirs(F.col("path"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(d)), lambda i: F.array_join(F.slice(d, 1, i), "/"))
    return (df.filter(F.col("path").contains("/"))
            .select("repo", "size", F.explode(prefixes).alias("dir"))
            .groupBy("repo", "dir").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes")))


def join_classified(scan: DataFrame, classified: DataFrame) -> DataFrame:
    """Scan rows with their category; files nobody classified are ``unknown`` with 0.0."""
    right = classified.select("repo", "path", "category", "confidence")
    return (scan.select("repo", "path", "ext", "size").join(right, ["repo", "path"], "left")
            .withColumn("category", F.coalesce("category", F.lit("unknown")))
            .withColumn("confidence", F.coalesce("confidence", F.lit(0.0))))
