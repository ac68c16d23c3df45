"""Writers for stages and documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", files: int = 8) -> None:
    """Persist a stage, one folder per repository of at most ``files`` files.

    Rows are dealt by repository and a salt from their path, so that a repository of a third of
    all rows is written by several tasks and a small one does not get a file from every task.
    """
    salt = F.pmod(F.xxhash64("path" if "path" in df.columns else "repo"), F.lit(files))
    df.repartition(F.col("repo"), salt).write.mode("overwrite").partitionBy("repo").format(fmt).save(path)


def write_documents(lines: DataFrame, path: str) -> None:
    """Markdown text per repository from ordered report lines.

    Lines are sorted by range, so a long document becomes several part files whose order is
    the order of the text; a normal one is a single part file.
    """
    order = ["repo", "section", "block", "ord", "sub"]
    (lines.repartitionByRange(*order).sortWithinPartitions(*order)
     .select("repo", F.col("line").alias("value")).write.mode("overwrite").partitionBy("repo").text(path))
