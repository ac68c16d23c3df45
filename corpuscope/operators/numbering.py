"""Row numbers, first-per-key and top-k within a key.

``row_number() <= k`` needs no special care: Spark keeps only the best k rows of a key in
every map task before it shuffles. A full numbering does: one key may hold a third of all
rows, and a window would sort it in one task. ``number_rows`` therefore measures the largest
key and numbers big keys from a range-partitioned sort instead.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import numbered
from ..session import hold

HOT_ROWS = 1_000_000


def _asc(order):
    return [c if isinstance(c, Column) else F.col(c) for c in order]


def number_rows(df: DataFrame, keys, order, out: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number the rows of every key 1, 2, 3 ... in ``order`` (which must have no ties)."""
    keys = list(keys)
    held = hold(df)
    largest = held.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= hot_rows:
        return held.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*_asc(order))))
    return _number_sorted(held, keys, order, out)


def _number_sorted(held: DataFrame, keys, order, out: str) -> DataFrame:
    """Distributed numbering: sort by range, count per (range, key), add the offsets.

    The sorted rows are held, so the running ids are fixed before they are used. Only the
    counts are windowed: one row per key and range.
    """
    ordered = [F.col(k) for k in keys] + _asc(order)
    placed = hold(held.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
                  .withColumn("_id", F.monotonically_increasing_id())
                  .withColumn("_slot", F.shiftright("_id", 33)))
    counts = placed.groupBy(*keys, "_slot").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = placed.join(offsets, [*keys, "_slot"])
    return (joined.withColumn(out, (F.col("_id") - F.col("_first") + F.col("_offset") + 1).cast("int"))
            .select(*held.columns, out))


def with_ids(df: DataFrame, keys, order, prefix: str, width: int = 0, out: str = "id",
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """``number_rows`` with a printed form such as ``feat-001`` or ``FR-1``."""
    return number_rows(df, keys, order, "n", hot_rows).withColumn(out, numbered(prefix, F.col("n"), width))


def top_k(df: DataFrame, keys, order, k: int, out: str = "rank") -> DataFrame:
    """the first k rows of every key; the limit is applied before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*_asc(order))
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """keep the first row of every key."""
    return top_k(df, keys, order, 1, "_rank").drop("_rank")


def batches(df: DataFrame, keys, order, size: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """ordered batches of a fixed size."""
    return number_rows(df, keys, order, "n", hot_rows).withColumn("batch", F.ceil(F.col("n") / size).cast("int"))
