"""Shared steps of the operators: inputs, hand-over tables and words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import shared_folder, small_batches

#: White space between words.
SPACES = "\\x20\\x09-\\x0D"


#: Options of a reader that takes a row group in pieces of 8 MB: read all at once, it lies outside the heap a second time.
IN_PIECES = {"parquet.hadoop.vectored.io.enabled": "false"}


def table(spark: SparkSession, folder: str, name: str, **options: str) -> DataFrame:
    return spark.read.options(**options).parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) and the columns ``more``; all others are left out."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def written(rows: DataFrame, purpose: str, **options: str) -> DataFrame:
    """``rows`` as a table in the shared folder: cuts lineage, survives lost executors."""
    path = shared_folder(rows.sparkSession, purpose)
    rows.write.options(**options).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts))


def batches(it: Iterator[pa.RecordBatch], chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of ``it`` in batches of about ``chars`` bytes at most, or of one row."""
    for b in it:
        step = max(1, int(b.num_rows * chars / max(1, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
    pa.default_memory_pool().release_unused()


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and how long they are."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return first, np.diff(np.r_[first, len(sorted_keys)])


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of unsigned numbers: multiply, shift and multiply."""
    x = (x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))
