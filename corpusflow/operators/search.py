"""One entry to all kinds of search, and how good the approximate ones are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.vectors import finite, score
from corpusflow.operators.graph import search_graph
from corpusflow.operators.ivf import assign_cells, collect_centroids, search_ivf, train_centroids
from corpusflow.operators.knn import TOP_K, search_exact
from corpusflow.operators.lsh import search_lsh

# The kinds of index. "hnsw" asks for a fast approximate search, along a graph of
# neighbours or in hash buckets.
METHODS = ("flat", "ivf", "hnsw")


def search(
    questions: DataFrame, vectors: DataFrame, k: int = TOP_K, method: str = "flat", **options
) -> DataFrame:
    """Best ``k`` vectors per question as ``(question_id, rank, vec_key, score)``.

    ``ivf`` takes ``centroids``, a table of them or an array, if ``vectors`` has the ``cell_id`` that
    they gave; without them it trains ``cells`` centroids first. ``hnsw`` goes along a ``graph`` from
    ``build_graph``; without one it looks into hash buckets.
    """
    if method not in METHODS:
        raise ValueError(f"Unknown index type: {method}")
    if method == "flat":
        return search_exact(questions, vectors, k, **options)
    if method == "hnsw":
        graph = options.pop("graph", None)
        return search_lsh(questions, vectors, k, **options) if graph is None else search_graph(questions, vectors, graph, k, **options)
    centroids, cells = options.pop("centroids", None), options.pop("cells", None)
    if centroids is None:
        centroids = train_centroids(vectors, cells)
        vectors = assign_cells(vectors, centroids)
    elif isinstance(centroids, DataFrame):
        centroids = collect_centroids(centroids)
    return search_ivf(questions, vectors, centroids, k, **options)


def search_one(vectors: DataFrame, question: list[float], k: int = TOP_K) -> DataFrame:
    """Best ``k`` vectors for a single question vector."""
    asked = F.array(*[F.lit(float(x)) for x in question])
    return (
        vectors.filter(finite(F.col("embedding")))
        .select("vec_key", score(F.col("embedding"), asked).alias("score"))
        .orderBy(F.desc("score"), F.asc("vec_key"))
        .limit(k)
    )


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that were found, per question."""
    hit = found.select("question_id", "vec_key", F.lit(1).alias("hit"))
    return (
        exact.select("question_id", "vec_key")
        .join(hit, ["question_id", "vec_key"], "left")
        .groupBy("question_id")
        .agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
    )
