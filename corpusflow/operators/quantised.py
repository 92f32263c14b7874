"""Exact search that scans one byte for each number and reads whole vectors for few rows only.

A code is a vector rounded to 255 steps, with the length of what rounding took. By Cauchy-Schwarz a
score from codes is off by at most that length times the question's, so a vector whose highest
possible score is below the ``k``-th of the lowest possible ones is no hit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.vectors import SCORE_DIGITS, finite, score
from corpusflow.operators.embedding import arrow_to_vectors
from corpusflow.operators.knn import BLOCK_CELLS, BROADCAST_BYTES, BROADCAST_HITS, BROADCAST_QUESTIONS, TOP_K, rank_hits
from corpusflow.session import handed_over, shared_folder

STEPS = 127
#: What final scores are rounded by, and what sums in another order may differ by.
SLACK = 2 * 10.0**-SCORE_DIGITS
#: Candidates of a task that wait before those below the floor are let go.
WAITING_ROWS = 1_000_000


def quantise(vectors: DataFrame) -> DataFrame:
    """``(vec_key, codes, scale, error)`` of ``vectors(vec_key, embedding)``: a byte for each number.

    ``error`` is the length of the difference between a vector and ``scale * codes``. Vectors with
    unknown numbers are left out, as a search does.
    """
    key = vectors.schema["vec_key"]
    added = [T.StructField("codes", T.BinaryType()), T.StructField("scale", T.DoubleType()), T.StructField("error", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = arrow_to_vectors(b.column("embedding"))
            scale = np.abs(v).max(axis=1, initial=0) / STEPS
            codes = np.rint(v / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            error = np.linalg.norm(v - codes * scale[:, None], axis=1)
            width = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * v.shape[1])
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, width.buffers()[1], pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("vec_key"), packed, pa.array(scale), pa.array(error)], names=["vec_key", "codes", "scale", "error"])

    return vectors.where(finite(F.col("embedding"))).select("vec_key", "embedding").mapInArrow(run, T.StructType([key, *added]))


def _candidates(asked: pa.Table, codes: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """``(question_id, vec_key, low, high)`` that a task cannot rule out by what it has seen."""
    matrix = arrow_to_vectors(asked.column("embedding").combine_chunks())
    sent = codes.sparkSession.sparkContext.broadcast((asked.column("question_id").combine_chunks(), matrix, np.linalg.norm(matrix, axis=1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, length = sent.value
        floor, best = np.full(len(q), -np.inf), np.full((len(q), k), -np.inf)
        waiting: list[pa.Table] = []

        def kept() -> pa.Table:
            found = pa.concat_tables(waiting)
            above = found.column("high").to_numpy() + SLACK >= floor[found.column("q").to_numpy()]
            return found.filter(pa.array(above)).combine_chunks()

        for b in batches:
            step = max(1, BLOCK_CELLS // max(1, len(q)))
            for at in range(0, b.num_rows, step):
                rows = b.slice(at, step)
                keys, packed = rows.column("vec_key"), pa.concat_arrays([rows.column("codes")])
                v = np.frombuffer(b"".join(packed.to_pylist()), np.int8).reshape(len(rows), -1)
                middle = (q @ v.T.astype(np.float64)) * rows.column("scale").to_numpy()
                off = length[:, None] * rows.column("error").to_numpy()
                best = -np.partition(np.concatenate([-best, off - middle], axis=1), k - 1, axis=1)[:, :k]
                floor = np.maximum(floor, best.min(axis=1))
                i, j = np.nonzero(middle + off + SLACK >= floor[:, None])
                waiting.append(pa.table([pa.array(i), keys.take(pa.array(j)), pa.array((middle - off)[i, j]), pa.array((middle + off)[i, j])], names=["q", "vec_key", "low", "high"]))
                if sum(map(len, waiting)) > WAITING_ROWS:
                    waiting = [kept()]
        if waiting:
            found = kept()
            out = pa.table([ids.take(found.column("q").combine_chunks()), *(found.column(c) for c in ("vec_key", "low", "high"))], names=["question_id", "vec_key", "low", "high"])
            yield from out.to_batches()

    return codes.select("vec_key", "codes", "scale", "error").mapInArrow(run, schema)


def search_quantised(questions: DataFrame, codes: DataFrame, vectors: DataFrame, k: int = TOP_K, survivors: list[int] | None = None) -> DataFrame:
    """The hits of ``search_exact``: codes are scanned, and vectors of the survivors scored.

    ``codes`` comes from ``quantise`` over the same ``vectors``, whose keys are distinct. Questions go to the
    tasks that scan the codes, in blocks of measured size. Tasks rule out what they can; then the
    ``k``-th lowest possible score over all tasks rules out more, and only what is left is
    joined with the vectors. How many rows are left is added to ``survivors``.
    """
    spark = questions.sparkSession
    asked = handed_over(questions.where(finite(F.col("embedding"))).select("question_id", "embedding"), "questions")
    count, numbers = asked.agg(F.count("*"), F.sum(F.size("embedding"))).first()
    fields = [asked.schema["question_id"], codes.schema["vec_key"]]
    schema = T.StructType([*fields, T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
    blocks = max(1, math.ceil(count / BROADCAST_QUESTIONS), math.ceil(8 * (numbers or 0) / BROADCAST_BYTES))
    path = shared_folder(spark, "candidates")
    spark.createDataFrame([], schema).write.parquet(path)
    for b in range(blocks if count else 0):
        block = asked.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b).toArrow()
        if block.num_rows:
            _candidates(block, codes, k, schema).write.mode("append").parquet(path)
    found = spark.read.schema(schema).parquet(path)
    lowest = W.partitionBy("question_id").orderBy(F.desc("low"))
    floor = found.withColumn("place", F.row_number().over(lowest)).where(F.col("place") == k).select("question_id", F.col("low").alias("floor"))
    left = found.join(floor, "question_id", "left").where(F.col("floor").isNull() | (F.col("high") + SLACK >= F.col("floor")))
    left = handed_over(left.select("question_id", "vec_key"), "survivors")
    n = left.count()
    if survivors is not None:
        survivors.append(n)
    few = F.broadcast(left) if n <= BROADCAST_HITS else left
    met = vectors.select("vec_key", "embedding").join(few, "vec_key").join(asked.withColumnRenamed("embedding", "asked"), "question_id")
    hits = met.select("question_id", "vec_key", (score(F.col("asked"), F.col("embedding")) + 0.0).alias("score"))
    return rank_hits(hits, k).select("question_id", "rank", "vec_key", "score")
