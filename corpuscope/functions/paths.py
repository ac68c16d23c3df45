"""Path helpers as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import lit_array


def parts(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirs(path: Column) -> Column:
    """Directory names above the file, outermost first."""
    p = parts(path)
    return F.slice(p, F.lit(1), F.size(p) - 1)


def suffix(path: Column) -> Column:
    """Extension with its dot, lower case; a leading dot alone is not an extension."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]+$", "$1")


def in_dirs(path: Column, names, lower: bool = False) -> Column:
    d = dirs(F.lower(path) if lower else path)
    return F.arrays_overlap(d, lit_array(names))


def top_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("root")


def path_parts(df):
    """B1: basename, stem, extension, depth and parent directory of every path."""
    p = F.col("path")
    return df.select("repo", "path", basename(p).alias("name"), stem(p).alias("stem"),
                     suffix(p).alias("ext"), F.size(parts(p)).alias("depth"),
                     F.array_join(dirs(p), "/").alias("dir"))
