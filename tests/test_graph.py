import numpy as np
from pyspark.sql import functions as F

from corpusflow.operators import graph, knn, search
from corpusflow.plans import tables

DIM = 12


def vectors_of(spark, data, name="vec_key"):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>")


def recall(found, exact):
    return search.recall(found, exact).agg(F.avg("recall")).first()[0]


def test_recall_on_the_tables(spark):
    """Nine of ten neighbours at least, for questions far from all vectors and for near ones."""
    folder = "/root/testdata/sf0.1"
    vectors = tables.vectors(spark, folder)
    made = graph.handed_over(graph.build_graph(vectors), "made")
    for asked in (tables.question_vectors(spark, folder, 64), vectors.where("vec_key % 50 = 0").select(F.col("vec_key").alias("question_id"), "embedding")):
        scored = []
        hits = graph.search_graph(asked, vectors, made, scored=scored)
        assert recall(hits, knn.search_exact(asked, vectors)) >= 0.9
        assert len(scored) <= graph.STEPS


def test_edges_are_near_and_bounded(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(600, DIM))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    rows = graph.build_graph(vectors_of(spark, data), degree=8).collect()
    s = data @ data.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1)[:, :8]
    assert sorted(r["vec_key"] for r in rows) == list(range(600))
    assert all(len(r["near"]) <= 16 and len(set(r["near"])) == len(r["near"]) and r["vec_key"] not in r["near"] for r in rows)
    assert np.mean([len(set(best[r["vec_key"]]) & set(r["near"])) / 8 for r in rows]) > 0.9


def test_copies_few_and_unknown(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(900, DIM))
    data[:700] = data[0]
    data[800] = np.nan
    vectors, asked = vectors_of(spark, data), vectors_of(spark, data[[0, 750, 800, 850]], "question_id")
    hits = graph.search_graph(asked, vectors, graph.build_graph(vectors))
    exact = knn.search_exact(asked, vectors)
    best = {(r["question_id"], r["rank"]): r["score"] for r in exact.collect()}
    got = {(r["question_id"], r["rank"]): r["score"] for r in hits.collect()}
    assert got.keys() == best.keys() and np.mean([got[x] == best[x] for x in best]) > 0.85
    for few in (data[:1], data[:2], data[:0]):
        vectors = vectors_of(spark, few)
        hits = graph.search_graph(asked, vectors, graph.build_graph(vectors))
        assert sorted(hits.collect()) == sorted(knn.search_exact(asked, vectors).collect())


def test_registered_searches_find_nine_of_ten(spark):
    from corpusflow.plans import queries

    folder = "/root/testdata/sf0.1"
    by_method = queries.knn_recall(spark, folder).groupBy("method").agg(F.avg("recall").alias("recall")).collect()
    assert len(by_method) == 2 and all(r["recall"] >= 0.9 for r in by_method)
    exact = knn.search_exact(queries._text_questions(spark, folder), tables.vectors(spark, folder))
    assert recall(queries.knn_graph(spark, folder), exact) >= 0.9
