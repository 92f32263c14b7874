"""Stored vectors, partitioned by cell, and the record that describes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names under which the kinds of index are recorded.
INDEX_NAMES = {"flat": "IndexFlatIP", "ivf": "IndexIVFFlat", "hnsw": "IndexHNSWFlat"}


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Write vectors; those with a ``cell_id`` into one folder per cell.

    Tasks write the cells they hold, so a cell with very many vectors becomes many files
    and needs no shuffle.
    """
    writer = vectors.write.mode("overwrite")
    if "cell_id" in vectors.columns:
        writer = writer.partitionBy("cell_id")
    writer.parquet(path)


def append_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("append").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_centroids(centroids: DataFrame, path: str) -> None:
    """Write the centroids ``(cell_id, embedding)`` that a vector table was parted by."""
    centroids.select("cell_id", "embedding").coalesce(1).write.mode("overwrite").parquet(path)


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_index_config(vectors: DataFrame, model_name: str, path: str, method: str = "flat") -> None:
    """Write the record of ``index_config`` beside an index."""
    index_config(vectors, model_name, method).coalesce(1).write.mode("overwrite").json(path)


def read_index_config(spark: SparkSession, path: str) -> DataFrame:
    kinds = "model_name string, embedding_dimension int, total_vectors long, index_type string"
    return spark.read.schema(kinds).json(path)


def index_config(vectors: DataFrame, model_name: str, method: str = "flat") -> DataFrame:
    """One row: model, dimension, number of vectors and kind of index."""
    return vectors.agg(
        F.lit(model_name).alias("model_name"),
        F.max(F.size("embedding")).alias("embedding_dimension"),
        F.count("*").alias("total_vectors"),
        F.lit(INDEX_NAMES[method]).alias("index_type"),
    )
