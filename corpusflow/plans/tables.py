"""The tables of a data folder in the roles of papers, questions and vectors.

Tables that take long to derive are written once per session and folder to the shared
folder, like the stages of a batch job that hand over through files.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.vectors import l2_normalize
from corpusflow.operators.bounded import read_cells, write_cells
from corpusflow.operators.chunking import chunk_documents, with_chunk_key
from corpusflow.operators.embedding import HashedWords, embed
from corpusflow.operators.graph import build_graph
from corpusflow.operators.ivf import assign_cells, collect_centroids, train_centroids
from corpusflow.operators.lsh import write_buckets
from corpusflow.operators.quantised import quantise
from corpusflow.session import handed_over, shared_folder
from corpusflow.sources.chunk_store import write_chunks
from corpusflow.sources.vector_store import read_centroids, read_vectors, write_centroids, write_vectors

MARKED_HEAD = "[opt]x\n\\documentclass[a]{b}\\usepackage{c}\n\\begin{document} \\section*{A   title}\n"
MARKED_TAIL = "\n\\cite{k} \\ref{r}\\label{l}  \\alpha_{x}\n  [z] keep?\nab\n\n\n\ndocument\n\\end{document}\n"

# Rows up to which a derived table is marked for broadcast.
SMALL_ROWS = 10_000

_stored: dict[tuple[str, str, str, str], str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small(rows: DataFrame) -> DataFrame:
    """``rows``, computed once and counted; marked for broadcast if there are few."""
    held = handed_over(rows, "small")
    return F.broadcast(held) if held.count() <= SMALL_ROWS else held


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as papers ``(doc_key, source_file, text)``."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("doc_key"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"),
        "text",
    )


def marked_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Papers with markup left-overs around their text."""
    marked = F.concat(F.lit(MARKED_HEAD), F.col("text"), F.lit(MARKED_TAIL))
    return papers(spark, folder).withColumn("text", marked)


def sectioned_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation turn as a paper with an introduction and headed sections."""
    turn = F.concat_ws(":", "conv_id", "turn")
    text = F.concat_ws(
        "\n", "text", "role", "text", F.lit("Results\nDiscussion"), "text", F.lit("1. Last part"), "text"
    )
    return table(spark, folder, "conversations").select(
        turn.alias("doc_key"), F.concat(turn, F.lit(".txt")).alias("source_file"), text.alias("text")
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question")
    )


def question_vectors(spark: SparkSession, folder: str, dimension: int) -> DataFrame:
    return embed(questions(spark, folder), HashedWords(dimension), "question")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` as vectors ``(vec_key, embedding, label)``."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("vec_key"), "embedding", F.col("label").cast("bigint").alias("label")
    )


def mean_vectors(rows: DataFrame, key: str) -> DataFrame:
    """Unit vector in the direction of the mean of each group: ``(key, embedding)``."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    means = rows.groupBy(key).agg(vector_to_array(mean).alias("m"))
    return means.select(key, l2_normalize(F.col("m")).alias("embedding"))


def label_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return mean_vectors(vectors(spark, folder), "label")


def _state(spark: SparkSession, path: str) -> str:
    """The files of a table with their lengths and times; changed data has another state."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    return str(tuple(listed.first()))


def _store(spark: SparkSession, folder: str, source: str, name: str, write) -> str:
    """Path of a derived table or index, written once for each state of its source."""
    key = (spark.sparkContext.applicationId, name, folder, _state(spark, f"{folder}/{source}.parquet"))
    if key not in _stored:
        path = shared_folder(spark, name)
        write(path)
        _stored[key] = path
    return _stored[key]


def stored_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table of the papers: ``(text, metadata, chunk_key, key_bucket)``."""
    return spark.read.parquet(
        _store(
            spark, folder, "documents", "chunks",
            lambda path: write_chunks(with_chunk_key(chunk_documents(papers(spark, folder))), path),
        )
    )


def stored_chunk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of the chunk table: ``(vec_key, embedding)``."""
    texts = stored_chunks(spark, folder).select(F.col("chunk_key").alias("vec_key"), "text")
    return spark.read.parquet(
        _store(spark, folder, "documents", "chunk-vectors", lambda path: write_vectors(embed(texts, HashedWords()), path))
    )


def stored_cells(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Vectors parted by cell, and the centroids: the mean directions of the labels."""

    def write(path: str) -> None:
        write_centroids(label_vectors(spark, folder).withColumnRenamed("label", "cell_id"), f"{path}/centroids")
        centroids = collect_centroids(read_centroids(spark, f"{path}/centroids"))
        write_vectors(assign_cells(vectors(spark, folder).select("vec_key", "embedding"), centroids), f"{path}/vectors")

    path = _store(spark, folder, "embeddings", "cells", write)
    return read_vectors(spark, f"{path}/vectors"), read_centroids(spark, f"{path}/centroids")


def stored_bounds(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Vectors parted by cells of k-means, and the cells with their reach."""

    def write(path: str) -> None:
        rows = vectors(spark, folder).select("vec_key", "embedding")
        centroids = train_centroids(rows)
        write_vectors(assign_cells(rows, centroids), f"{path}/vectors")
        write_cells(read_vectors(spark, f"{path}/vectors"), centroids, f"{path}/cells")

    path = _store(spark, folder, "embeddings", "bounds", write)
    return read_vectors(spark, f"{path}/vectors"), read_cells(spark, f"{path}/cells")


def stored_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The graph of neighbours of the vectors: ``(vec_key, near)``."""
    return spark.read.parquet(
        _store(spark, folder, "embeddings", "graph", lambda path: build_graph(vectors(spark, folder)).write.parquet(path))
    )


def stored_codes(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors with a byte for each number."""
    return spark.read.parquet(
        _store(spark, folder, "embeddings", "codes", lambda path: quantise(vectors(spark, folder)).write.parquet(path))
    )


def stored_buckets(spark: SparkSession, folder: str, tables: int, bits: int) -> str:
    """Path of the vectors stored by hash bucket."""
    return _store(
        spark, folder, "embeddings", f"buckets-{tables}-{bits}", lambda path: write_buckets(vectors(spark, folder), path, tables, bits)
    )
