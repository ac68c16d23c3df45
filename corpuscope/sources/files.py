"""File tables: scanning, pruning and size limits. All operators need only ``path`` to prune."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.paths import dirs, suffix
from ..functions.text import lit_array
from ..rules.languages import REGISTRY, Registry
from ..rules.signals import PACK_EXTS, SKIP_DIRS


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root/<repo>/...`` as a files table, read with Spark's binary source.

    The text stays null where the bytes are not valid UTF-8 (see ``drop_binary``).
    """
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root))
    base = F.lit(root.rstrip("/") + "/")
    # the reported path has a scheme in front; the root is looked for as it stands
    rel = F.substr("path", F.instr("path", base) + F.length(base))
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string"))
    return raw.select(F.substring_index(rel, "/", 1).alias("repo"),
                      F.regexp_replace(rel, "^[^/]+/", "").alias("path"),
                      F.col("length").alias("size"), text.alias("content")) \
              .withColumn("ext", suffix(F.col("path")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on an input that comes in fewer pieces than there are cores.

    A large table has many more pieces than cores and is left as it is, unshuffled. The keys
    make the placement repeatable when a task runs again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def prune_dirs(df: DataFrame, names) -> DataFrame:
    return df.filter(~F.arrays_overlap(dirs(F.col("path")), lit_array(names)))


def scan_files(df: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """A1: files outside ignored directories, with lower-case extension and size."""
    out = prune_dirs(df, registry.ignore_dirs).withColumn("ext", suffix(F.col("path")))
    return out if "size" in df.columns else out.withColumn("size", F.octet_length("content").cast("long"))


def drop_binary(df: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """A2: drop binary extensions (before reading content), then content that is not UTF-8 text."""
    text = df.filter(~F.lower("ext").isin(list(registry.binary_exts)))
    return text.filter(F.col("content").isNotNull() & F.expr("is_valid_utf8(content)"))


def read_with_limits(df: DataFrame, exts, skip_dirs, max_bytes: int | None = None) -> DataFrame:
    """A10: pre-filter of the analysis packs; touches path and extension only.

    Files of any size are read; ``max_bytes`` leaves larger ones out where a caller wants that.
    """
    kept = df.filter(F.col("ext").isin(list(exts)))
    return prune_dirs(kept if max_bytes is None else kept.filter(F.col("size") <= max_bytes), skip_dirs)


def pack_filter(pack: str):
    """The same as a condition, for operators that serve several packs in one pass."""
    return (F.col("ext").isin(list(PACK_EXTS[pack]))
            & ~F.arrays_overlap(dirs(F.col("path")), lit_array(SKIP_DIRS[pack])))


def pack_files(df: DataFrame, pack: str) -> DataFrame:
    return read_with_limits(df, PACK_EXTS[pack], SKIP_DIRS[pack])
