"""Documents to chunks with metadata, and their statistics.

Every document is worked on within its row: cleaning, sections, packing, numbering and
per-document statistics need no shuffle and run unchanged on a stream.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.clean import clean_lines
from corpusflow.functions.packing import (
    Packing,
    section_chunks,
    segments_of,
    worded_section,
    words_per_segment,
)
from corpusflow.functions.sections import cut_sections, header_positions
from corpusflow.functions.text import has_unusual_space, materialize, strip
from corpusflow.session import small_batches

# Fixed value: how much of a chunk a preview shows.
PREVIEW_LENGTH = 200

METADATA_FIELDS = (
    "paper_id",
    "chunk_index",
    "total_chunks",
    "section",
    "char_count",
    "token_count",
    "source_file",
)


@functools.cache
def _steps(p: Packing, application: str) -> dict[str, Column]:
    """The columns of the chunking job, in the order in which they are added.

    Building them takes over a thousand calls to the JVM, so they are kept for the time of
    the Spark application.
    """
    text, unusual = F.col("text"), F.col("unusual")
    worded = F.transform(
        "sections", lambda s: worded_section(s["section"], s["text"], unusual, p)
    )
    prepared = F.arrays_zip(
        *[
            F.transform("worded", lambda s: s[field]).alias(field)
            for field in ("section", "text", "n_words", "words")
        ],
        "segments",
        F.transform("segments", lambda x: words_per_segment(x, unusual)).alias("segment_words"),
    )

    def chunks_of(s: Column) -> Column:
        return F.transform(
            section_chunks(s, p),
            lambda c: F.struct(s["section"], strip(c["text"]).alias("text"), c["tokens"]),
        )

    failed = F.coalesce("no_text", p.counter.measure_error(F.col("measured")))
    made = F.flatten(F.transform(F.when(failed.isNull(), F.col("measured")), chunks_of))
    counts, why = F.col("counted.counts"), F.coalesce("failed", "counted.error")
    numbered = F.when(counts.isNull(), F.col("made")).otherwise(
        F.zip_with("made", counts, lambda c, n: c.withField("tokens", n))
    )
    return {
        "no_text": F.when(text.isNull(), F.lit("no text")),
        "unusual": has_unusual_space(text),
        "lines": clean_lines(text),
        "headers": header_positions(F.col("lines")),
        "sections": cut_sections(F.col("lines"), F.col("headers")),
        "worded": F.filter(worded, lambda s: s["n_words"] > 0),
        "segments": F.transform("worded", lambda s: segments_of(s, p)),
        "prepared": prepared,
        "measured": p.counter.measure(F.col("prepared"), p.chunk_size),
        "failed": failed,
        "made": F.filter(made, lambda c: F.length(c["text"]) >= p.min_chars),
        "counted": p.counter.count_texts(F.transform("made", lambda c: c["text"])),
        "error": why,
        "chunks": F.when(why.isNull(), numbered),
    }


def chunk_arrays(documents: DataFrame, p: Packing = Packing()) -> DataFrame:
    """One row per document with its chunks as ``array<struct<section, text, tokens>>``.

    ``documents`` has ``doc_key``, ``source_file`` and ``text``. A document without text, or
    for which the token counter raises, fails alone: it keeps its row, with an ``error`` and
    no chunks.
    """
    if p.counter.in_python:
        small_batches(documents.sparkSession)
    steps = _steps(p, documents.sparkSession.sparkContext.applicationId)
    kept: list[str | Column] = ["doc_key", "source_file"]

    def add(rows: DataFrame, *names: str, keep: tuple[str, ...]) -> DataFrame:
        return rows.select(*kept, *keep, *[steps[n].alias(n) for n in names])

    # Each step names columns of the one before more than once, which keeps the steps apart
    # in the plan and every array evaluated a single time.
    rows = add(documents, "no_text", "unusual", "lines", keep=())
    kept.append("no_text")
    rows = add(rows, "headers", keep=("unusual", "lines"))
    rows = add(rows, "sections", keep=("unusual",))
    rows = add(rows, "worded", keep=("unusual",))
    rows = add(rows, "segments", keep=("unusual", "worded"))
    rows = add(rows, "prepared", keep=())
    rows = add(rows, "measured", keep=())
    rows = add(rows, "failed", "made", keep=())
    kept.remove("no_text")
    if p.counter.in_python:
        rows = materialize(rows, steps["counted"], "counted")
    else:
        rows = add(rows, "counted", keep=("failed", "made"))
    return add(rows, "error", "chunks", keep=())


def explode_chunks(arrays: DataFrame) -> DataFrame:
    """Chunk rows ``(text, metadata)`` out of ``chunk_arrays``."""
    # The outer form keeps the optimizer from adding a non-empty test below the generator,
    # which would evaluate the whole chunking expression a second time.
    rows = (
        arrays.withColumn("_total", F.size("chunks"))
        .select(
            "doc_key",
            "source_file",
            "_total",
            F.posexplode_outer("chunks").alias("_index", "_chunk"),
        )
        .filter(F.col("_index").isNotNull())
    )
    return rows.select(
        F.col("_chunk.text").alias("text"),
        F.struct(
            F.col("doc_key").cast("string").alias("paper_id"),
            F.col("_index").alias("chunk_index"),
            F.col("_total").alias("total_chunks"),
            F.col("_chunk.section").alias("section"),
            F.length("_chunk.text").alias("char_count"),
            F.col("_chunk.tokens").alias("token_count"),
            "source_file",
        ).alias("metadata"),
    )


def chunk_documents(documents: DataFrame, p: Packing = Packing()) -> DataFrame:
    """Chunks of all documents as ``(text, metadata)`` rows."""
    return explode_chunks(chunk_arrays(documents, p))


def with_chunk_key(chunks: DataFrame) -> DataFrame:
    """Add the key that ties vectors and hits to chunks: paper and index."""
    return chunks.withColumn("chunk_key", F.concat_ws("#", "metadata.paper_id", "metadata.chunk_index"))


def document_statistics(documents: DataFrame, p: Packing = Packing()) -> DataFrame:
    """Chunks and tokens per document, documents without chunks included."""
    arrays = chunk_arrays(documents, p)
    held = materialize(arrays, F.col("chunks"), "_held").drop("chunks").withColumnRenamed("_held", "chunks")
    return held.select(
        "doc_key",
        F.col("source_file").alias("filename"),
        "error",
        F.when(F.col("error").isNull(), F.size("chunks")).otherwise(0).alias("chunks"),
        F.coalesce(
            F.aggregate("chunks", F.lit(0).cast("bigint"), lambda a, c: a + c["tokens"]), F.lit(0).cast("bigint")
        ).alias("tokens"),
    )


def statistics_of_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The same statistics from a stored chunk table; reads no chunk text."""
    per_paper = chunks.groupBy(F.col("metadata.paper_id").alias("doc_key")).agg(
        F.count("*").alias("chunks"), F.sum("metadata.token_count").alias("tokens")
    )
    scanned = documents.select(
        F.col("doc_key").cast("string").alias("doc_key"), F.col("source_file").alias("filename")
    )
    return scanned.join(per_paper, "doc_key", "left").select(
        "doc_key",
        "filename",
        F.coalesce("chunks", F.lit(0)).cast("int").alias("chunks"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
    )


def corpus_statistics(statistics: DataFrame) -> DataFrame:
    """Totals over document statistics, as one row."""
    totals = statistics.agg(
        F.count("*").alias("total_documents"),
        F.coalesce(F.sum("chunks"), F.lit(0)).cast("bigint").alias("total_chunks"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
    )
    mean = F.try_divide("total_tokens", "total_chunks").cast("double")
    return totals.withColumn("avg_chunk_size", F.coalesce(mean, F.lit(0.0)))


def failed_documents(arrays: DataFrame) -> DataFrame:
    return arrays.filter(F.col("error").isNotNull()).select("doc_key", "source_file", "error")


def preview_chunks(chunks: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` chunks in document order, with the beginning of their text."""
    return (
        chunks.select(
            "metadata.paper_id",
            "metadata.chunk_index",
            "metadata.section",
            "metadata.token_count",
            F.substring("text", 1, PREVIEW_LENGTH).alias("preview"),
        )
        .orderBy("paper_id", "chunk_index")
        .limit(n)
    )


def preview_documents(documents: DataFrame, p: Packing = Packing(), n: int = 3) -> DataFrame:
    """``preview_chunks`` of a corpus: only so many first papers are chunked as it takes."""
    ordered = documents.orderBy(F.col("doc_key").cast("string"))
    papers, total = n, None
    while True:
        preview = preview_chunks(chunk_documents(ordered.limit(papers), p), n)
        if preview.count() >= n:
            return preview
        total = documents.count() if total is None else total
        if papers >= total:
            return preview
        papers *= 4
