"""Approximate search in cells around centroids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.vectors import SCORE_DIGITS, finite
from corpusflow.operators.embedding import arrow_to_vectors
from corpusflow.operators.knn import TOP_K, search_cells

# Fixed value: the most cells of an index unless the caller asks for more.
MAX_CELLS = 100
# Centroids that are sent to every task: so many numbers of eight bytes.
CENTROID_NUMBERS = 8_000_000


def cell_count(vectors: int) -> int:
    """Number of cells for an index of so many vectors."""
    return min(math.isqrt(vectors), MAX_CELLS)


def train_centroids(vectors: DataFrame, cells: int | None = None, seed: int = 7) -> np.ndarray:
    """Centroids of spherical k-means over all vectors of the ``embedding`` column.

    Vectors without a direction (zeros, unknown numbers) do not take part. Without any vector
    there are no cells.
    """
    known = vectors.filter(finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    rows = known.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    total = known.count()
    if total == 0:
        return np.zeros((0, 0))
    cells = min(cells or max(1, cell_count(total)), total)
    if cells < 2:
        return np.array([known.select("embedding").first()["embedding"]], dtype=np.float64)
    model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=20).fit(rows)
    return np.array(model.clusterCenters())


def centroid_rows(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    """Centroids as a table ``(cell_id, embedding)``."""
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    return spark.createDataFrame(rows, "cell_id long, embedding array<double>")


def collect_centroids(centroids: DataFrame) -> np.ndarray:
    """Centroids given as rows ``(cell_id, embedding)``, numbered 0, 1, 2, ...

    Their size is checked before they come to the driver.
    """
    numbers = centroids.agg(F.sum(F.size("embedding"))).first()[0] or 0
    if numbers > CENTROID_NUMBERS:
        raise ValueError(f"centroids of more than {CENTROID_NUMBERS} numbers cannot be sent to every task")
    rows = centroids.select("cell_id", "embedding").orderBy("cell_id").collect()
    if [r["cell_id"] for r in rows] != list(range(len(rows))):
        raise ValueError("cells must be numbered from 0 without a gap")
    return np.array([r["embedding"] for r in rows], dtype=np.float64)


def nearest_cells(rows: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """Add ``cells``: the ``n`` cells with the highest inner product, best first."""
    if not len(centroids):
        return rows.filter(F.lit(False)).withColumn("cells", F.array().cast("array<bigint>"))
    n = min(n, len(centroids))
    fields = rows.schema.fields
    schema = T.StructType([*fields, T.StructField("cells", T.ArrayType(T.LongType()))])
    # Of checked size, see ``collect_centroids``.
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            if batch.num_rows:
                scores = np.round(arrow_to_vectors(batch.column("embedding")) @ table.T, SCORE_DIGITS)
                # A stable sort gives ties to the lower cell number.
                best = np.argsort(-scores, axis=1, kind="stable")[:, :n].astype(np.int64)
                offsets = np.arange(0, best.size + 1, n, dtype=np.int32)
                cells = pa.ListArray.from_arrays(offsets, pa.array(best.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, cells], names=[*batch.schema.names, "cells"]
                )

    return rows.filter(finite(F.col("embedding"))).mapInArrow(run, schema)


def assign_cells(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add the ``cell_id`` of each vector, for a table partitioned by cell."""
    return nearest_cells(vectors, centroids, 1).withColumn("cell_id", F.get("cells", F.lit(0))).drop("cells")


def search_ivf(
    questions: DataFrame,
    assigned: DataFrame,
    centroids: np.ndarray,
    k: int = TOP_K,
    nprobe: int = 1,
    **options,
) -> DataFrame:
    """Best ``k`` vectors per question within its ``nprobe`` nearest cells.

    ``assigned(vec_key, embedding, cell_id)`` comes from ``assign_cells``, or from a table
    that was written partitioned by ``cell_id``; cells that no question looks into are then
    not read.
    """
    probing = nearest_cells(questions.select("question_id", "embedding"), centroids, nprobe)
    cells = F.array(F.col("cell_id").cast("bigint")).alias("cells")
    vectors = assigned.select("vec_key", "embedding", "cell_id", cells)
    return search_cells(probing, vectors, k, one_cell=True, cell_column="cell_id", **options)
