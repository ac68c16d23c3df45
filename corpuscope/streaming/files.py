"""Per-file operators on a stream of files.

Classification, chunking and signal rules look at one file at a time, so they take a stream
as they take a table; nothing here keeps state.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.chunks import chunk_lines
from ..operators.classify import classify_files
from ..operators.signals import presence_signals
from ..sources.files import drop_binary, scan_files

FILES = "repo string, path string, ext string, size bigint, content string"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of a files table, as a stream."""
    return scan_files(drop_binary(spark.readStream.schema(FILES).parquet(folder)))


def stream_signals(files: DataFrame) -> DataFrame:
    return presence_signals(files)


def stream_chunks(files: DataFrame) -> DataFrame:
    return chunk_lines(classify_files(files))
