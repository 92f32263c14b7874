"""Stored chunks: Parquet for work, JSON for exchange."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.text import materialize
from corpusflow.operators.chunking import corpus_statistics
from corpusflow.sources import text_files

# Layout of a chunk file.
METADATA = (
    "struct<paper_id:string,chunk_index:int,total_chunks:int,section:string,char_count:int,"
    "token_count:int,source_file:string>"
)
CHUNK_SCHEMA = f"text string, metadata {METADATA}"
CONFIG_SCHEMA = "chunk_size int, chunk_overlap int, encoding string"
TOTALS_SCHEMA = "total_documents long, total_chunks long, total_tokens long, avg_chunk_size double"
CHUNKS_SCHEMA = f"chunks array<struct<text:string,metadata:{METADATA}>>"
CHUNK_FILE_SCHEMA = f"""
    {CHUNKS_SCHEMA},
    statistics struct<total_documents:int,total_chunks:int,total_tokens:bigint,
        avg_chunk_size:double,
        documents_processed:array<struct<filename:string,chunks:int,tokens:int>>>,
    config struct<chunk_size:int,chunk_overlap:int,encoding:string>
"""


# Folders that a stored chunk table is parted into by key; lookups read those that they need.
KEY_BUCKETS = 16


def key_bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Write chunks with their key as Parquet, parted by ``key_bucket``.

    Tasks write the buckets of the chunks they hold, so nothing is shuffled.
    """
    bucketed = chunks.withColumn("key_bucket", key_bucket(F.col("chunk_key")))
    bucketed.write.mode("overwrite").partitionBy("key_bucket").parquet(path)


def write_run(chunks: DataFrame, statistics: DataFrame, config: dict[str, int | str], path: str) -> None:
    """Write a chunking job: its chunks, what it says about each document, totals and settings.

    ``statistics`` is that of ``document_statistics``; each of the four is a table of its own.
    """
    write_chunks(chunks, f"{path}/chunks")
    statistics.write.mode("overwrite").parquet(f"{path}/documents")
    stored = chunks.sparkSession.read.parquet(f"{path}/documents")
    corpus_statistics(stored).write.mode("overwrite").json(f"{path}/statistics")
    chunks.sparkSession.createDataFrame([config]).coalesce(1).write.mode("overwrite").json(f"{path}/config")


def read_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a stored chunking job by name: chunks, documents, statistics, config."""
    return {
        "chunks": spark.read.parquet(f"{path}/chunks"),
        "documents": spark.read.parquet(f"{path}/documents"),
        "statistics": spark.read.schema(TOTALS_SCHEMA).json(f"{path}/statistics"),
        "config": spark.read.schema(CONFIG_SCHEMA).json(f"{path}/config"),
    }


def write_chunks_json(chunks: DataFrame, path: str) -> None:
    """Write chunks as JSON, one object per line, in as many files as there are tasks."""
    chunks.select("text", "metadata").write.mode("overwrite").json(path)


def read_chunks_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).json(path)


def _utf8(content: bytes) -> bytes | None:
    """JSON in UTF-8, whichever Unicode encoding the file has; None if it is broken."""
    try:
        return content.decode(json.detect_encoding(content)).encode()
    except UnicodeError:
        return None


def read_chunk_file(spark: SparkSession, *paths: str) -> DataFrame:
    """Chunks of exchange files that hold one object ``{chunks, statistics, config}`` each.

    Folders may hold millions of files, so tasks list and read them; single files, patterns and
    stores that only Spark reaches are read by Spark's source.
    """
    if all(text_files.is_folder(spark, path) for path in paths):
        contents = text_files.read_folders(spark, *paths, pattern="*", deep=True, made_of=_utf8)
        parsed = F.from_json(F.col("content").cast("string"), CHUNKS_SCHEMA)
        files = materialize(contents.select("content"), parsed, "file").select("file.chunks")
    else:
        files = spark.read.schema(CHUNK_FILE_SCHEMA).option("multiLine", True).json(list(paths))
    return files.select(F.explode("chunks").alias("c")).select("c.text", "c.metadata")


def read_chunk_file_statistics(spark: SparkSession, path: str) -> DataFrame:
    """The recorded statistics and settings of such files."""
    files = spark.read.schema(CHUNK_FILE_SCHEMA).option("multiLine", True).json(path)
    return files.select("statistics.*", "config.*")
