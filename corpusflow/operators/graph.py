"""Approximate search along a graph of neighbours that is kept as a table.

The graph has an edge list of bounded length for each vector. It is made by joins: near vectors are
first met in buckets of random planes, then each vector introduces its neighbours to each other
(NN-descent). A search moves the beams of all questions along the edges at once, a step a round.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.functions.vectors import SCORE_DIGITS, finite, score
from corpusflow.operators.embedding import arrow_to_vectors
from corpusflow.operators.knn import TOP_K, rank_hits, search_exact
from corpusflow.session import handed_over

#: Neighbours that a vector keeps, and as many more that keep it.
DEGREE = 16
#: Buckets in which a vector meets others at the start, of about so many vectors each.
MEETINGS, MEETING = 4, 128
#: Rounds of introductions; new partners that a member of a group reports in one.
ROUNDS, REPORTED = 3, 6
#: Groups of vectors that a task takes at a time are about so many rows.
TASK_ROWS = 20_000
#: Candidates a question keeps, those it expands in a round, and the most rounds.
BEAM, EXPANDED, STEPS = 48, 8, 12
#: Vectors among which a search finds its first candidates.
ENTRIES = 512


def _partners(t: pa.Table, group: str, most: int) -> pa.Table:
    """Of each member of each group the ``most`` others of the group with the highest scores."""
    t = t.sort_by([(group, "ascending"), ("vec_key", "ascending")])
    groups, keys = t.column(group).to_numpy(), t.column("vec_key").combine_chunks()
    v = arrow_to_vectors(t.column("embedding").combine_chunks())
    left, right, scores = [], [], []
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else []
    for a, b in zip(starts, [*starts[1:], len(groups)]):
        s = np.round(v[a:b] @ v[a:b].T, SCORE_DIGITS) + 0.0
        np.fill_diagonal(s, -np.inf)
        take = np.argsort(-s, axis=1, kind="stable")[:, : min(most, b - a - 1)]
        left.append(np.repeat(np.arange(a, b), take.shape[1]))
        right.append(a + take.ravel())
        scores.append(np.take_along_axis(s, take, axis=1).ravel())
    left, right = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (left, right))
    return pa.table([keys.take(pa.array(left)), keys.take(pa.array(right)), pa.array(np.concatenate([np.zeros(0), *scores]))], names=["vec_key", "other", "score"])


def _introduced(members: DataFrame, rows: int, most: int) -> DataFrame:
    """``(vec_key, other, score)`` of members ``(meets long, vec_key, embedding)`` that meet in a group."""
    kind = members.schema["vec_key"].dataType.simpleString()
    tasks = max(1, -(-rows // TASK_ROWS))
    dealt = members.withColumn("task", F.pmod(F.xxhash64("meets"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(lambda t: _partners(t, "meets", most), f"vec_key {kind}, other {kind}, score double")


def _best(edges: DataFrame, most: int, by: str = "vec_key", order: Column | None = None) -> DataFrame:
    """The ``most`` best edges of each vector. Tasks cut theirs first, so a hub's edges meet in no task."""
    first = order if order is not None else F.desc("score")
    place = W.partitionBy(by).orderBy(first, F.asc("other" if by == "vec_key" else "vec_key"))
    return edges.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).drop("place")


def _both_ways(edges: DataFrame, degree: int) -> DataFrame:
    """Edges, and up to ``degree`` of those that lead to a vector turned round."""
    back = _best(edges, degree, "other").select(F.col("other").alias("vec_key"), F.col("vec_key").alias("other"), "score")
    return edges.unionByName(back).dropDuplicates(["vec_key", "other"])


def build_graph(vectors: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, seed: int = 5) -> DataFrame:
    """``(vec_key, near)`` of ``vectors(vec_key, embedding)``: the keys of near vectors, the nearest first.

    Keys are distinct; vectors with unknown numbers are left out. ``near`` holds up to ``degree``
    neighbours and as many vectors that have this one as theirs. Groups are bounded: a bucket with
    too many vectors, of copies for example, is dealt by key into several. What a round shuffles is
    ``3 * degree`` vectors and some hundred scores for each vector, whatever their number.
    """
    known = handed_over(vectors.where(finite(F.col("embedding"))).select("vec_key", "embedding"), "graph-vectors")
    n, width = known.agg(F.count("*"), F.max(F.size("embedding"))).first()
    edges = known.select("vec_key", F.col("vec_key").alias("other"), F.lit(0.0).alias("score")).limit(0)
    if n:
        bits = max(0, round(math.log2(max(1.0, n / MEETING))))
        planes = np.random.default_rng(seed).normal(size=(MEETINGS, bits, width))

        def side(plane: np.ndarray, bit: int) -> Column:
            return F.when(score(F.col("embedding"), F.array(*map(F.lit, plane.tolist()))) > 0, 1 << bit).otherwise(0)

        sides = [sum((side(p, b) for b, p in enumerate(table)), F.lit(0)).cast("long") for table in planes]
        met = known.select("vec_key", "embedding", F.posexplode(F.array(*sides)).alias("table", "side"))
        crowd = met.groupBy("table", "side").agg(F.ceil(F.count("*") / (2 * MEETING)).alias("parts"))
        # Two to the number of bits rows for each table: about as many as vectors fill buckets.
        place = F.xxhash64("table", "side", F.pmod(F.xxhash64("vec_key", "table"), "parts"))
        groups = met.join(crowd, ["table", "side"]).select(place.alias("meets"), "vec_key", "embedding")
        edges = _introduced(groups, MEETINGS * n, degree)
    edges = handed_over(_best(edges.dropDuplicates(["vec_key", "other"]), degree), "graph")
    for _ in range(rounds if n else 0):
        group = _both_ways(edges, degree).select(F.xxhash64("vec_key").alias("meets"), F.col("other").alias("vec_key"))
        group = group.unionByName(known.select(F.xxhash64("vec_key").alias("meets"), "vec_key"))
        found = _introduced(group.join(known, "vec_key"), (2 * degree + 1) * n, REPORTED)
        edges = handed_over(_best(edges.unionByName(found).dropDuplicates(["vec_key", "other"]), degree), "graph")
    near = _both_ways(edges, degree).groupBy("vec_key").agg(F.sort_array(F.collect_list(F.struct("score", "other")), asc=False).alias("near"))
    return known.select("vec_key").join(near, "vec_key", "left").select(
        "vec_key", F.coalesce(F.transform("near", lambda e: e["other"]), F.array().cast(f"array<{known.schema['vec_key'].dataType.simpleString()}>")).alias("near")
    )


def search_graph(
    questions: DataFrame, vectors: DataFrame, graph: DataFrame, k: int = TOP_K, beam: int = BEAM, steps: int = STEPS, scored: list[int] | None = None
) -> DataFrame:
    """About the best ``k`` vectors per question: ``(question_id, rank, vec_key, score)``.

    A beam of each question begins with the best of ``ENTRIES`` vectors that a hash picks. In a
    round it expands its ``EXPANDED`` best candidates, which adds their neighbours that it has not
    scored before, and keeps the ``beam`` best. It ends when all of a beam are expanded, or after
    ``steps`` rounds, each of two joins: the candidates with the graph and their neighbours with the
    vectors. Of up to ``ENTRIES`` vectors all are scored at the start, so the hits are those of an exact
    search. The number of scores of each round is added to ``scored``. Vectors and questions with unknown
    numbers have no hits.
    """
    asked = handed_over(questions.where(finite(F.col("embedding"))).select("question_id", F.col("embedding").alias("asked")), "graph-questions")
    known = vectors.where(finite(F.col("embedding"))).select("vec_key", "embedding")
    share = max(1, known.count() // ENTRIES)
    entries = known.where(F.pmod(F.xxhash64("vec_key"), F.lit(share)) == 0)
    first = search_exact(asked.withColumnRenamed("asked", "embedding"), entries, beam)
    seen = handed_over(first.select("question_id", "vec_key", "score", F.lit(False).alias("done"), F.lit(True).alias("held")), "beam")
    order = W.partitionBy("question_id").orderBy(F.desc("score"), F.asc("vec_key"))
    for _ in range(steps):
        waiting = seen.where("held AND NOT done").withColumn("place", F.row_number().over(order)).where(F.col("place") <= EXPANDED)
        waiting = handed_over(waiting.select("question_id", "vec_key"), "frontier")
        if waiting.isEmpty():
            break
        reached = waiting.join(graph, "vec_key").select("question_id", F.explode("near").alias("vec_key")).distinct()
        new = reached.join(seen.select("question_id", "vec_key"), ["question_id", "vec_key"], "left_anti")
        met = new.join(known, "vec_key").join(asked, "question_id")
        found = handed_over(met.select("question_id", "vec_key", (score(F.col("asked"), F.col("embedding")) + 0.0).alias("score")), "reached")
        if scored is not None:
            scored.append(found.count())
        done = seen.join(waiting.withColumn("now", F.lit(True)), ["question_id", "vec_key"], "left")
        both = done.select("question_id", "vec_key", "score", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done")).unionByName(
            found.withColumn("done", F.lit(False))
        )
        # What a beam has let go stays as seen, so that it is not scored again.
        seen = handed_over(both.withColumn("held", F.row_number().over(order) <= beam), "beam")
    return rank_hits(seen.where("held").select("question_id", "vec_key", "score"), k).select("question_id", "rank", "vec_key", "score")
