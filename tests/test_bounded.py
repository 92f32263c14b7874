import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import bounded, ivf, knn

K, DIM = 5, 12


def vectors_of(spark, data):
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "vec_key long, embedding array<double>").repartition(4)


def questions_of(spark, data):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "question_id long, embedding array<double>")


def found(hits):
    return sorted(tuple(r) for r in hits.select("question_id", "rank", "vec_key", "score").collect())


def both(spark, data, asked, centroids, tmp_path, k=K):
    vectors, questions = vectors_of(spark, data), questions_of(spark, asked)
    assigned = ivf.assign_cells(vectors, centroids).cache()
    bounded.write_cells(assigned, centroids, str(tmp_path / "cells"))
    rounds = []
    hits = bounded.search_bounded(questions, assigned, bounded.read_cells(spark, str(tmp_path / "cells")), k, rounds)
    assert found(hits) == found(knn.search_exact(questions, vectors, k))
    return rounds


def clustered(rng, n, scale=True):
    centres = rng.normal(size=(40, DIM))
    rows = centres[rng.integers(0, 40, n)] + 0.1 * rng.normal(size=(n, DIM))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True) if scale else rows, centres


def test_clustered_vectors_are_read_in_part(spark, tmp_path):
    rng = np.random.default_rng(1)
    data, centres = clustered(rng, 2000)
    centroids = ivf.train_centroids(vectors_of(spark, data))
    rounds = both(spark, data, centres[:10], centroids, tmp_path)
    # Of 2,000 vectors for each of ten questions.
    assert sum(r.scores for r in rounds) < 0.4 * 2000 * 10


@pytest.mark.parametrize("kind", ["lengths", "random", "ties", "negative"])
def test_equals_the_exact_search(spark, tmp_path, kind):
    rng = np.random.default_rng(2)
    data, centres = clustered(rng, 600, scale=False)
    asked = centres[:6]
    if kind == "lengths":
        data = data * rng.uniform(0.01, 20, (600, 1))
        data[5], data[6] = 0, np.nan
        asked = np.vstack([asked, np.zeros(DIM), 100 * asked[0], np.full(DIM, np.inf)])
    elif kind == "random":
        data, asked = rng.normal(size=(600, DIM)), rng.normal(size=(6, DIM))
    elif kind == "ties":
        data[::2] = data[0]
    else:
        data = -np.abs(data)
        asked = np.abs(asked)
    centroids = np.array([c / np.linalg.norm(c) for c in centres[:15]] + [np.zeros(DIM)])
    rounds = both(spark, data, asked, centroids, tmp_path)
    assert len(rounds) <= 6


def test_few_vectors(spark, tmp_path):
    data = np.eye(DIM)[:3]
    assert both(spark, data, np.eye(DIM)[:2], data, tmp_path)
    vectors = vectors_of(spark, []).withColumn("cell_id", F.lit(0).cast("bigint"))
    cells = spark.createDataFrame([], "cell_id long, embedding array<double>, n long, least_cos double, least_norm double, most_norm double, radius double")
    hits = bounded.search_bounded(questions_of(spark, data), vectors, cells)
    assert hits.columns == ["question_id", "rank", "vec_key", "score"] and hits.count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for _ in range(50):
        centroid = rng.normal(size=(1, DIM))
        v = rng.normal(size=(30, DIM)) * rng.uniform(0.1, 3, (30, 1)) + centroid * rng.choice([0, 1, 5])
        q = rng.normal(size=(7, DIM))
        norm = np.linalg.norm(v, axis=1)
        cos = (v @ centroid[0]) / norm / np.linalg.norm(centroid)
        reach = {k: np.array([x]) for k, x in (("least_cos", cos.min()), ("least_norm", norm.min()), ("most_norm", norm.max()), ("radius", np.linalg.norm(v - centroid, axis=1).max()))}
        assert (bounded.upper_bounds(q, centroid, reach)[:, 0] >= (q @ v.T).max(axis=1) - 1e-9).all()
