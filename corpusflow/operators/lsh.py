"""Approximate search in hash buckets: signs of projections on random directions.

Several hash tables are kept; a vector is a candidate if it shares the bucket of the
question in one of them. Candidates are scored exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.vectors import finite
from corpusflow.operators.embedding import arrow_to_vectors
from corpusflow.operators.knn import TOP_K, search_cells

# Decimals of a projection that count for its sign, so that it does not hang on the order
# of a sum.
SIGN_DIGITS = 9


def directions(tables: int, bits: int, dimension: int) -> np.ndarray:
    """Directions of +1 and -1 entries, one row per table and bit, the same everywhere."""

    def entry(row: int, i: int) -> float:
        return 1.0 if hashlib.md5(f"{row}:{i}".encode()).hexdigest()[0] < "8" else -1.0

    return np.array([[entry(r, i) for i in range(dimension)] for r in range(tables * bits)])


def bucket_cells(rows: DataFrame, tables: int, bits: int) -> DataFrame:
    """Add ``cells``: one bucket number per hash table, made unique across tables."""
    schema = T.StructType(
        [*rows.schema.fields, T.StructField("cells", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if batch.num_rows:
                matrix = arrow_to_vectors(batch.column("embedding"))
                if planes is None:
                    planes = directions(tables, bits, matrix.shape[1])
                signs = np.round(matrix @ planes.T, SIGN_DIGITS) >= 0
                numbers = signs.reshape(-1, tables, bits) @ (1 << np.arange(bits))
                numbers = numbers + (np.arange(tables) << bits)
                offsets = np.arange(0, numbers.size + 1, tables, dtype=np.int32)
                cells = pa.ListArray.from_arrays(offsets, pa.array(numbers.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, cells], names=[*batch.schema.names, "cells"]
                )

    return rows.filter(finite(F.col("embedding"))).mapInArrow(run, schema)


def bits_for(vectors: int, wanted: int = 100) -> int:
    """Bits of a bucket so that about ``wanted`` of evenly spread vectors share one."""
    return max(1, min(20, round(math.log2(max(2, vectors / wanted)))))


def search_lsh(
    questions: DataFrame,
    vectors: DataFrame,
    k: int = TOP_K,
    tables: int = 8,
    bits: int = 6,
    **options,
) -> DataFrame:
    """Best ``k`` among the vectors that share a bucket with the question.

    Hashes all vectors; ``search_buckets`` reads stored buckets instead.
    """
    return search_cells(
        bucket_cells(questions.select("question_id", "embedding"), tables, bits),
        bucket_cells(vectors.select("vec_key", "embedding"), tables, bits),
        k,
        one_cell=tables == 1,
        **options,
    )


def write_buckets(vectors: DataFrame, path: str, tables: int = 8, bits: int | None = None) -> None:
    """Store vectors by bucket, once for each hash table, so that a search reads what it asks for.

    ``bits`` follow from the number of vectors unless they are given. Both settings are stored
    beside the buckets.
    """
    bits = bits or bits_for(vectors.count())
    rows = bucket_cells(vectors.select("vec_key", "embedding"), tables, bits)
    rows.select("vec_key", "embedding", F.explode("cells").alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(
        f"{path}/buckets"
    )
    settings = vectors.sparkSession.createDataFrame([(tables, bits)], "tables int, bits int")
    settings.coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def search_buckets(questions: DataFrame, path: str, k: int = TOP_K, **options) -> DataFrame:
    """``search_lsh`` over buckets stored by ``write_buckets``; reads only those of the questions."""
    spark = questions.sparkSession
    tables, bits = spark.read.schema("tables int, bits int").json(f"{path}/settings").first()
    stored = spark.read.parquet(f"{path}/buckets")
    cells = F.array(F.col("bucket").cast("bigint")).alias("cells")
    return search_cells(
        bucket_cells(questions.select("question_id", "embedding"), tables, bits),
        stored.select("vec_key", "embedding", "bucket", cells),
        k,
        one_cell=True,
        cell_column="bucket",
        spread_cells=tables > 1,
        **options,
    )
