"""Top-k search by inner product.

Vectors and questions meet in cells. An exact search has one cell; the approximate ones
give each vector some cells and each question the cells to look into. Only the best ``k``
of each task leave it, so what is shuffled does not grow with the pairs that were scored.

Questions are sent to the tasks that scan the vectors, which stay where they are, so no key
can become a hot spot. Questions that are too many or too large for that go in blocks, each
of which is a scan of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.vectors import SCORE_DIGITS
from corpusflow.operators.embedding import arrow_to_vectors
from corpusflow.session import handed_over, shared_folder

# Fixed value: default number of hits.
TOP_K = 5

# What may be sent to every task: so many questions, so many bytes, so many hits.
BROADCAST_QUESTIONS = 50_000
BROADCAST_BYTES = 256 << 20
BROADCAST_HITS = 1_000_000
# How many scores are held at a time, for how many questions, and how many candidates wait.
BLOCK_CELLS = 4_000_000
BLOCK_QUESTIONS = 2_000
WAITING_ROWS = 2_000_000


class Best:
    """The best ``k`` keys of each question seen so far in one task."""

    def __init__(self, k: int, questions: int, key_type: pa.DataType, repeated: bool):
        self.k, self.repeated, self.waiting = k, repeated, 0
        # The score that a key has to reach to be among the best of a question.
        self.floor = np.full(questions, -np.inf)
        self.schema = pa.schema(
            [("q", pa.int64()), ("key", key_type), ("score", pa.float64())]
        )
        self.parts: list[pa.Table] = [self.schema.empty_table()]

    def add(self, questions: np.ndarray, keys: pa.Array, scores: np.ndarray) -> None:
        """Take the best of a block of scores, one row per question, one column per key."""
        needed = self.floor[questions, None]
        if scores.shape[1] > self.k:
            last = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k, None]
            needed = np.maximum(needed, last)
        # Ties with the last place stay in; the key decides among them later.
        row, col = np.nonzero(scores >= needed)
        found = [questions[row], keys.take(pa.array(col)), scores[row, col]]
        self.parts.append(pa.table(found, schema=self.schema))
        self.waiting += len(row)
        if self.waiting > WAITING_ROWS:
            self.compact()

    def compact(self) -> pa.Table:
        found = pa.concat_tables(self.parts).combine_chunks()
        if self.repeated and found.num_rows:
            found = found.sort_by([("q", "ascending"), ("key", "ascending"), ("score", "descending")])
            q, key = (found.column(c).combine_chunks() for c in ("q", "key"))
            same = pc.and_(pc.equal(q[1:], q[:-1]), pc.equal(key[1:], key[:-1]))
            found = found.filter(pa.concat_arrays([pa.array([True]), pc.invert(same)]))
        found = found.sort_by([("q", "ascending"), ("score", "descending"), ("key", "ascending")])
        q = found.column("q").to_numpy()
        first = np.searchsorted(q, q, side="left")
        place = np.arange(len(q)) - first
        full = place == self.k - 1
        self.floor[q[full]] = found.column("score").to_numpy()[full]
        found = found.filter(pa.array(place < self.k))
        self.parts, self.waiting = [found], 0
        return found


def _score_block(best: Best, q_index, q_matrix, keys: pa.Array, v_matrix) -> None:
    """Score all questions against all keys of a cell, a block at a time."""
    step = BLOCK_CELLS // min(BLOCK_QUESTIONS, max(1, len(q_index)))
    for v in range(0, len(v_matrix), step):
        some_keys, columns = keys.slice(v, step), v_matrix[v : v + step].T
        for q in range(0, len(q_index), BLOCK_QUESTIONS):
            rows = slice(q, q + BLOCK_QUESTIONS)
            # Adding zero turns a negative zero into a plain one.
            best.add(q_index[rows], some_keys, np.round(q_matrix[rows] @ columns, SCORE_DIGITS) + 0.0)


def _hits_schema(question_type: T.DataType, key_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("question_id", question_type),
            T.StructField("vec_key", key_type),
            T.StructField("score", T.DoubleType()),
        ]
    )


def rank_hits(hits: DataFrame, k: int, groups: int = 1) -> DataFrame:
    """Number the best ``k`` hits of each question from 1, ties by key.

    Every task brings at most ``k`` hits per question. With very many tasks a first round
    over ``groups`` parts of each question keeps the last round small.
    """
    order = [F.desc("score"), F.asc("vec_key")]
    if groups > 1:
        part = F.pmod(F.xxhash64("vec_key"), F.lit(groups))
        first = W.partitionBy("question_id", part).orderBy(*order)
        hits = hits.withColumn("_rank", F.row_number().over(first))
        hits = hits.filter(F.col("_rank") <= k).drop("_rank")
    by_question = W.partitionBy("question_id").orderBy(*order)
    ranked = hits.withColumn("rank", F.row_number().over(by_question))
    return ranked.filter(F.col("rank") <= k)


def _scan(
    table: pa.Table, vectors: DataFrame, k: int, schema: T.StructType, one_cell: bool
) -> DataFrame:
    ids = table.column("question_id").to_pylist()
    matrix = arrow_to_vectors(table.column("embedding").combine_chunks()) if ids else np.zeros((0, 0))
    by_cell: dict[int, list[int]] = {}
    asking = np.isfinite(matrix).all(axis=1) if ids else []
    for i, cells in enumerate(table.column("cells").to_pylist()):
        if not asking[i]:
            continue
        for cell in cells:
            by_cell.setdefault(cell, []).append(i)
    sent = vectors.sparkSession.sparkContext.broadcast(
        (pa.array(ids, table.schema.field("question_id").type), matrix,
         {c: np.array(i) for c, i in by_cell.items()})
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        question_ids, q_matrix, q_of_cell = sent.value
        best = None
        for batch in batches:
            if batch.num_rows == 0 or len(question_ids) == 0:
                continue
            keys = batch.column("vec_key")
            best = best or Best(k, len(question_ids), keys.type, repeated=not one_cell)
            v_matrix = arrow_to_vectors(batch.column("embedding"))
            cells = batch.column("cells")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(cells.offsets.to_numpy()))
            flat = cells.flatten().to_numpy(zero_copy_only=False)
            # A vector with an unknown number has no score and must not take a place.
            whole = np.isfinite(v_matrix).all(axis=1)[rows]
            flat, rows = flat[whole], rows[whole]
            order = np.argsort(flat, kind="stable")
            flat, rows = flat[order], rows[order]
            starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else []
            for a, b in zip(starts, [*starts[1:], len(flat)]):
                asking = q_of_cell.get(int(flat[a]))
                if asking is not None:
                    inside = rows[a:b]
                    _score_block(
                        best, asking, q_matrix[asking], keys.take(pa.array(inside)), v_matrix[inside]
                    )
            best.compact()
        if best is not None:
            found = best.compact()
            out = pa.table(
                [question_ids.take(found.column("q").combine_chunks()), found.column("key"),
                 found.column("score")],
                names=["question_id", "vec_key", "score"],
            )
            yield from out.to_batches()

    return vectors.select("vec_key", "embedding", "cells").mapInArrow(run, schema)


def search_cells(
    questions: DataFrame,
    vectors: DataFrame,
    k: int = TOP_K,
    one_cell: bool = False,
    block_questions: int = BROADCAST_QUESTIONS,
    cell_column: str | None = None,
    rank_groups: int = 1,
    spread_cells: bool = False,
) -> DataFrame:
    """Best ``k`` vectors per question among those that share a cell with it.

    ``questions(question_id, embedding, cells)`` and ``vectors(vec_key, embedding, cells)``
    give ``(question_id, rank, vec_key, score)``. Vectors and questions with unknown numbers
    have no hits. ``one_cell`` states that no row of ``vectors`` has more than one cell, and
    ``spread_cells`` that rows of one vector stand apart, one for each cell.

    Questions are computed once, into the shared folder, and measured there. Up to
    ``block_questions`` and ``BROADCAST_BYTES`` of them go to all tasks at a time; with more
    than one such block every block's hits are written before the next is scanned. Otherwise
    nothing of the vectors is read before the result is. The hits of few questions are marked
    for broadcast, so that looking up their chunks does not shuffle the chunks. If
    ``cell_column`` names the one cell of a vector, unasked cells are filtered out by it,
    which skips their files in a table partitioned by that column. With very many tasks,
    ``rank_groups`` parts of each question are ranked before the whole.
    """
    known = F.col("embedding").isNotNull()
    questions = handed_over(questions.select("question_id", "embedding", "cells").filter(known), "questions")
    vectors = vectors.filter(known)
    schema = _hits_schema(
        questions.schema["question_id"].dataType, vectors.schema["vec_key"].dataType
    )
    count, numbers = questions.agg(F.count("*"), F.sum(F.size("embedding") + F.size("cells"))).first()
    blocks = max(1, math.ceil(count / block_questions), math.ceil(8 * (numbers or 0) / BROADCAST_BYTES))
    block = F.pmod(F.xxhash64("question_id"), F.lit(blocks))

    def hits_of(b: int) -> DataFrame:
        sent = questions.filter(block == b).toArrow()
        rows = vectors
        if cell_column:
            asked = {c for cells in sent.column("cells").to_pylist() for c in cells}
            rows = vectors.filter(F.col(cell_column).isin(sorted(asked)))
        return _scan(sent, rows, k, schema, one_cell and not spread_cells)

    if blocks == 1:
        hits = hits_of(0)
    else:
        path = shared_folder(questions.sparkSession, "hits")
        for b in range(blocks):
            hits_of(b).write.mode("append").parquet(path)
        hits = questions.sparkSession.read.schema(schema).parquet(path)
    if spread_cells:
        hits = hits.groupBy("question_id", "vec_key").agg(F.max("score").alias("score"))
    ranked = rank_hits(hits, k, rank_groups).select("question_id", "rank", "vec_key", "score")
    return F.broadcast(ranked) if count * k <= BROADCAST_HITS else ranked


def search_exact(questions: DataFrame, vectors: DataFrame, k: int = TOP_K, **options) -> DataFrame:
    """Best ``k`` of all vectors for each question; see ``search_cells`` for the options."""
    everywhere = F.array(F.lit(0).cast("bigint")).alias("cells")
    return search_cells(
        questions.select("question_id", "embedding", everywhere),
        vectors.select("vec_key", "embedding", everywhere),
        k,
        one_cell=True,
        **options,
    )
