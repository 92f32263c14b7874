"""Connected components of a graph that is only known as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import written

#: Edges that a task joins at a time; what is left of them is a forest.
BLOCK_EDGES = 500_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges, and the least node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x < y:
            root[y] = x
        else:
            root[x] = y
    for k, r in enumerate(root):  # roots are smaller than what hangs on them
        root[k] = root[r]
    return nodes, nodes[root]


def _joined(edges: DataFrame) -> DataFrame:
    """The edges of each task as stars, block by block."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def stars() -> pa.RecordBatch:
            nodes, roots = union_find(*(np.concatenate([np.asarray(b.column(k)) for b in waiting]) for k in (0, 1)))
            apart = nodes != roots
            return pa.record_batch([pa.array(nodes[apart]), pa.array(roots[apart])], ["a", "b"])

        for b in it:
            waiting.append(b)
            n += b.num_rows
            if n >= BLOCK_EDGES:
                yield stars()
                waiting, n = [], 0
        if waiting:
            yield stars()

    return edges.mapInArrow(each, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of each node on the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the least of these. Edges lead to the smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all edges are stars: no node hangs on two others, or on one and has others on it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    of_node = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return of_node.where((F.col("hangs") > 1) | ((F.col("hangs") == 1) & (F.col("holds") == 1))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of each node with an edge, the root being the least node of its component.

    ``edges``: two columns of longs, in any direction and number; nulls and loops are left out.
    Tasks first join what they hold by union-find, then the stars that are left meet: each round
    moves the neighbours of a node to the least of them, which takes a number of rounds that grows as
    the logarithm of the longest path. Each round is written to the shared folder.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    oriented = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = written(_joined(oriented), "edges")
    while not _settled(now):
        now = written(_small_star(_large_star(now)), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
