"""Chunking of documents as they arrive.

Chunking works within the row of a document, so the stream keeps no state: the checkpoint
only remembers which files were done, and a broken-off run goes on behind them. Where papers are
delivered again, a versioned table keeps the last delivery of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusflow.functions.packing import Packing
from corpusflow.operators.chunking import chunk_arrays, chunk_documents, explode_chunks
from corpusflow.session import handed_over
from corpusflow.sources import versioned


def start_chunk_stream(
    documents: DataFrame, out: str, checkpoint: str, p: Packing = Packing()
) -> StreamingQuery:
    """Chunk all documents that are there now into the Parquet table ``out``."""
    return (
        chunk_documents(documents, p)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_paper_stream(
    documents: DataFrame, table: str, checkpoint: str, p: Packing = Packing(), name: str = "papers"
) -> StreamingQuery:
    """Chunk all deliveries that are there now into the versioned table ``table``, the last of each paper.

    ``documents`` has ``delivered``, a number that grows with the deliveries of a paper. Each micro-batch
    keeps the last delivery of a paper, passes over papers of which the table has the same or a
    later one, and replaces the rest in one commit. A micro-batch that runs again after a failure
    is known by ``name`` and its number, so it leaves no second copy. Read with ``current_chunks``.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = W.partitionBy("doc_key").orderBy(F.desc("delivered"), F.xxhash64("text"))
        rows = batch.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place")
        if versioned.manifest(spark, table):
            held = versioned.read_version(spark, table, ["doc_key", "delivered"]).withColumnRenamed("delivered", "_held")
            rows = rows.join(held, "doc_key", "left").where("_held IS NULL OR delivered > _held").drop("_held")
        rows = handed_over(rows.select("doc_key", "source_file", "text", "delivered"), "delivered")
        made = chunk_arrays(rows, p).join(rows.select("doc_key", "delivered"), "doc_key")
        versioned.commit(made, rows.select("doc_key"), table, ["doc_key"], batch=f"{name}:{number}")

    return documents.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_chunks(spark: SparkSession, table: str) -> DataFrame:
    """Chunks ``(text, metadata)`` of the last delivery of each paper."""
    return explode_chunks(versioned.read_version(spark, table))
