"""Exact search that reads few cells: bounds on the score prove that the rest has nothing better."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.vectors import SCORE_DIGITS, finite
from corpusflow.operators.embedding import arrow_to_vectors
from corpusflow.operators.ivf import collect_centroids
from corpusflow.operators.knn import TOP_K, rank_hits, search_cells
from corpusflow.session import handed_over, shared_folder

#: What scores are rounded by, and what sums in another order may differ by.
SLACK = 2 * 10.0**-SCORE_DIGITS


@dataclass
class Round:
    """What one round read: questions asked, cells and vectors scanned, question-vector scores."""

    questions: int
    cells: int
    vectors: int
    scores: int


def cell_reach(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """How far each cell reaches: ``(cell_id, n, least_cos, least_norm, most_norm, radius)``.

    ``least_cos`` is the cosine of the largest angle between a vector of the cell and its centroid,
    ``radius`` the largest distance from it. Vectors with unknown numbers are left out; a vector
    without a direction counts as one at any angle. One row for each cell and task is shuffled.
    """
    sent = assigned.sparkSession.sparkContext.broadcast(centroids)
    schema = "cell_id long, n long, least_cos double, least_norm double, most_norm double, radius double"

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        length = np.linalg.norm(table, axis=1)
        for b in batches:
            if not b.num_rows:
                continue
            v, cell = arrow_to_vectors(b.column("embedding")), b.column("cell_id").to_numpy()
            order = np.argsort(cell, kind="stable")
            v, cell = v[order], cell[order]
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            norm, centre = np.linalg.norm(v, axis=1), table[cell]
            scale = norm * length[cell]
            cos = np.where(scale > 0, np.einsum("ij,ij->i", v, centre) / np.where(scale > 0, scale, 1), -1.0)
            far = np.linalg.norm(v - centre, axis=1)
            yield pa.RecordBatch.from_pydict(
                {
                    "cell_id": cell[first], "n": np.diff(np.r_[first, len(cell)]),
                    "least_cos": np.minimum.reduceat(cos, first), "least_norm": np.minimum.reduceat(norm, first),
                    "most_norm": np.maximum.reduceat(norm, first), "radius": np.maximum.reduceat(far, first),
                }
            )

    rows = assigned.filter(finite(F.col("embedding"))).select("embedding", F.col("cell_id").cast("bigint").alias("cell_id"))
    return rows.mapInArrow(reach, schema).groupBy("cell_id").agg(
        F.sum("n").alias("n"), F.min("least_cos").alias("least_cos"), F.min("least_norm").alias("least_norm"),
        F.max("most_norm").alias("most_norm"), F.max("radius").alias("radius"),
    )


def write_cells(assigned: DataFrame, centroids: np.ndarray, path: str) -> None:
    """Write centroids with the reach of their cells, to be read by ``read_cells``."""
    spark = assigned.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    table = spark.createDataFrame(rows, "cell_id long, embedding array<double>")
    table.join(F.broadcast(cell_reach(assigned, centroids)), "cell_id", "left").coalesce(1).write.mode("overwrite").parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def upper_bounds(questions: np.ndarray, centroids: np.ndarray, reach: dict[str, np.ndarray]) -> np.ndarray:
    """No vector of a cell has a higher inner product with a question: a row for each question.

    The smaller of two bounds: by the least angle that a question can have with a vector of the
    cell, and by the distance from the centroid.
    """
    q, c = np.linalg.norm(questions, axis=1), np.linalg.norm(centroids, axis=1)
    products = questions @ centroids.T
    scale = q[:, None] * c
    cos = np.where(scale > 0, products / np.where(scale > 0, scale, 1), 1.0)
    # Where a centroid has no direction nothing is known about angles.
    apart = np.arccos(np.clip(cos, -1, 1)) - np.where(c > 0, np.arccos(np.clip(reach["least_cos"], -1, 1)), np.pi)
    near = np.cos(np.clip(apart, 0, np.pi))
    by_angle = q[:, None] * np.where(near >= 0, near * reach["most_norm"], near * reach["least_norm"])
    return np.minimum(by_angle, products + q[:, None] * reach["radius"])


def _planned(questions: DataFrame, centroids: np.ndarray, reach: dict[str, np.ndarray], k: int) -> DataFrame:
    """Questions with the ``cells`` that hold vectors, by falling bound, and ``first`` of them that hold ``k``."""
    sent = questions.sparkSession.sparkContext.broadcast((centroids, reach))
    added = [T.StructField("cells", T.ArrayType(T.LongType())), T.StructField("bounds", T.ArrayType(T.DoubleType())), T.StructField("first", T.LongType())]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, far = sent.value
        held = np.flatnonzero(far["n"] > 0)
        for b in batches:
            if not b.num_rows:
                continue
            bounds = upper_bounds(arrow_to_vectors(b.column("embedding")), centres[held], {n: x[held] for n, x in far.items()})
            order = np.argsort(-bounds, axis=1, kind="stable")
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(held))
            cells = pa.ListArray.from_arrays(offsets, pa.array(held[order].ravel().astype(np.int64)))
            sorted_ = pa.ListArray.from_arrays(offsets, pa.array(np.take_along_axis(bounds, order, axis=1).ravel()))
            enough = 1 + (np.cumsum(far["n"][held][order], axis=1) < k).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, cells, sorted_, pa.array(enough.astype(np.int64))], names=[*b.schema.names, "cells", "bounds", "first"])

    known = questions.filter(finite(F.col("embedding"))).select("question_id", "embedding")
    return known.mapInArrow(plan, T.StructType([*known.schema.fields, *added]))


def search_bounded(
    questions: DataFrame, assigned: DataFrame, cells: DataFrame, k: int = TOP_K, rounds: list[Round] | None = None, **options
) -> DataFrame:
    """The hits of ``search_exact``, from the cells that can hold one.

    ``assigned(vec_key, embedding, cell_id)`` is best stored partitioned by ``cell_id``; ``cells`` comes
    from ``write_cells`` over the same rows. Each question takes its cells by falling upper bound:
    first as many as hold ``k`` vectors, then four times as many in each round, as long as the next
    bound reaches its ``k``-th score. So there are at most as many rounds as the logarithm of the
    number of cells, each one scan of the cells that some question asks for, and a question is done
    when no vector of its other cells can be among its hits. What the rounds read is added to
    ``rounds``. Without any vector there are no hits.
    """
    spark = questions.sparkSession
    table = cells.select("cell_id", "n", "least_cos", "least_norm", "most_norm", "radius")
    centroids = collect_centroids(cells)  # checks the size of the table
    rows = table.orderBy("cell_id").collect()
    reach = {c: np.array([float(r[c] or 0) for r in rows]) for c in table.columns[1:]}
    key = questions.schema["question_id"], assigned.schema["vec_key"], T.StructField("score", T.DoubleType())
    if not reach["n"].sum():
        return spark.createDataFrame([], T.StructType([key[0], T.StructField("rank", T.IntegerType()), *key[1:]]))
    state = handed_over(_planned(questions, centroids, reach, k).withColumn("at", F.lit(0).cast("bigint")), "bounded")
    path = shared_folder(spark, "bounded-hits")
    found = spark.createDataFrame([], T.StructType(list(key)))
    todo = state.withColumn("upto", F.col("first"))
    while not todo.isEmpty():
        part = todo.select("question_id", "embedding", F.expr("slice(cells, cast(at + 1 as int), cast(upto - at as int))").alias("cells"))
        if rounds is not None:
            rounds.append(_read(part, reach["n"]))
        bigint = F.array(F.col("cell_id").cast("bigint")).alias("cells")
        vectors = assigned.select("vec_key", "embedding", "cell_id", bigint)
        hits = search_cells(part, vectors, k, one_cell=True, cell_column="cell_id", **options)
        hits.select("question_id", "vec_key", "score").write.mode("append").parquet(path)
        found = spark.read.schema(T.StructType(list(key))).parquet(path)
        floor = rank_hits(found, k).where(F.col("rank") == k).select("question_id", F.col("score").alias("floor"))
        # Cells come by falling bound, so those that are still open are the next ones.
        left = todo.drop("floor").join(floor, "question_id", "left").withColumn(
            "open", F.size(F.filter("bounds", lambda b: F.col("floor").isNull() | (b + SLACK >= F.col("floor")))).cast("bigint")
        )
        more = F.least(F.col("open"), 5 * F.col("upto") - 4 * F.col("at"))
        left = left.where(F.col("open") > F.col("upto")).select(*state.columns, F.col("upto").alias("old"), more.alias("upto"))
        todo = handed_over(left.withColumn("at", F.col("old")).drop("old"), "bounded")
    return rank_hits(found, k).select("question_id", "rank", "vec_key", "score")


def _read(part: DataFrame, n: np.ndarray) -> Round:
    asked = part.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("asking")).collect()
    return Round(
        part.count(), len(asked), int(sum(n[r["cell"]] for r in asked)), int(sum(n[r["cell"]] * r["asking"] for r in asked))
    )
