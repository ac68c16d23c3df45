"""What the operators of this subpackage share: folds, samples, gradient jobs."""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuscope.session import hold, release  # noqa: F401  (used by the operators)

#: Regular expression of a run of ASCII white space, as in the contracts.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, mod ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def bytes_of(name: str = "text") -> Column:
    return text_of(name).cast("binary")


def bounded_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``key``: the same rows however they are partitioned."""
    return df.withColumn("_h", F.xxhash64(key)).orderBy("_h", key).limit(n).drop("_h")


def whole_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``docs`` as the struct _doc, so that no name meets those given here."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *[c.alias(n) for n, c in columns.items()])


def in_slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices, so that a task has few of a batch's texts as Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def packed(batch: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(batch[f.name], f.type) for f in schema], schema=schema)


def summed_gradient(rows: DataFrame, columns: list[str],
                    gradient: Callable[[dict[str, np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """Sum over the rows of a bounded sample of a gradient vector of fixed length.

    Each task adds up its own rows and returns one vector. ``in_few_files`` bounds the tasks.
    """
    schema = pa.schema([("part", pa.list_(pa.float64()))])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += gradient({c: b.column(c).to_numpy(zero_copy_only=False) for c in columns})
        yield packed({"part": [total]}, schema)

    return np.sum([np.zeros(size), *(r["part"] for r in rows.select(*columns).mapInArrow(part, "part array<double>").collect())], axis=0)


def in_few_files(sample: DataFrame) -> DataFrame:
    """The rows of a bounded sample, held in a few files for the jobs that read them again and again."""
    return hold(sample.coalesce(8))


def adam(start: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int, rate: float) -> np.ndarray:
    """Adam with the usual decay rates; the step size falls to a tenth."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w
