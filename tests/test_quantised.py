import numpy as np
import pytest

from corpusflow.operators import knn, quantised

DIM, K = 24, 5


def rows_of(spark, data, name="vec_key"):
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>").repartition(3)


def found(hits):
    return sorted(tuple(r) for r in hits.collect())


@pytest.mark.parametrize("kind", ["random", "ties", "lengths", "few", "none"])
def test_equals_the_exact_search(spark, kind):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(800, DIM))
    asked = rng.normal(size=(20, DIM))
    if kind == "ties":
        data[::2] = data[0]
    elif kind == "lengths":
        data *= rng.uniform(1e-3, 1e3, (800, 1))
        data[3], data[4], asked[2], asked[3] = 0, np.nan, 0, np.nan
    elif kind == "few":
        data = data[:3]
    elif kind == "none":
        data = data[:0]
    vectors, questions = rows_of(spark, data), rows_of(spark, asked, "question_id")
    left = []
    hits = quantised.search_quantised(questions, quantised.quantise(vectors), vectors, K, left)
    assert found(hits) == found(knn.search_exact(questions, vectors, K))
    if kind == "random":
        # A handful of rows for each question, of 800.
        assert left[0] < 20 * 12
    assert found(quantised.search_quantised(questions.limit(0), quantised.quantise(vectors), vectors, K)) == []


def test_errors_are_bounds(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(200, DIM)).astype(np.float32)
    q = rng.normal(size=(10, DIM))
    for r in quantised.quantise(rows_of(spark, data)).collect():
        code = np.frombuffer(r["codes"], np.int8) * r["scale"]
        v = data[r["vec_key"]].astype(float)
        assert len(r["codes"]) == DIM
        assert (np.abs(q @ code - q @ v) <= np.linalg.norm(q, axis=1) * r["error"] + 1e-9).all()
