import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.functions.vectors import l2_normalize, score
from corpusflow.operators import embedding, ivf, knn, lsh, search
from corpusflow.sources import vector_store

DIM, N, Q, K = 16, 400, 30, 5


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(8, DIM))
    rows = centers[rng.integers(0, 8, N)] + 0.4 * rng.normal(size=(N, DIM))
    # A third of the rows are copies of one vector.
    rows[::3] = rows[0]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return rows.astype(np.float32).astype(float)


@pytest.fixture(scope="module")
def tables(spark, data):
    vectors = spark.createDataFrame(
        [(f"v{i:03d}", [float(x) for x in r]) for i, r in enumerate(data)], "vec_key string, embedding array<float>"
    ).repartition(5)
    questions = spark.createDataFrame(
        [(i, [float(x) for x in data[i]]) for i in range(Q)], "question_id long, embedding array<float>"
    )
    return questions, vectors


def brute(data, allowed=lambda q, v: True):
    hits = set()
    scores = np.round(data[:Q] @ data.T, 6)
    for q in range(Q):
        order = sorted((-scores[q, v], f"v{v:03d}") for v in range(N) if allowed(q, v))
        hits |= {(q, r + 1, key, -s) for r, (s, key) in enumerate(order[:K])}
    return hits


def found(hits):
    return {tuple(r) for r in hits.collect()}


BLOCKS = pytest.mark.parametrize("block", [50_000, 7])


@BLOCKS
def test_exact(tables, data, block):
    hits = search.search_exact(*tables, K, block_questions=block)
    assert found(hits) == brute(data)


@pytest.mark.parametrize("repeated", [False, True])
def test_best_in_small_blocks(data, monkeypatch, repeated):
    """Many small blocks and early clean-ups keep the same hits."""
    monkeypatch.setattr(knn, "BLOCK_CELLS", 70)
    monkeypatch.setattr(knn, "BLOCK_QUESTIONS", 7)
    monkeypatch.setattr(knn, "WAITING_ROWS", 50)
    keys = pa.array([f"v{i:03d}" for i in range(N)])
    best = knn.Best(K, Q, keys.type, repeated)
    for _ in range(1 + repeated):
        knn._score_block(best, np.arange(Q), data[:Q], keys, data)
    rows = best.compact().to_pylist()
    assert {(r["q"], r["key"], r["score"]) for r in rows} == {(q, v, s) for q, _, v, s in brute(data)}


def test_first_round_of_ranking_changes_nothing(spark, tables, data):
    every = spark.createDataFrame(
        [(q, f"v{v:03d}", float(s)) for q in range(Q) for v, s in enumerate(np.round(data[q] @ data.T, 6))],
        "question_id long, vec_key string, score double",
    )
    ranked = knn.rank_hits(every, K, groups=7).select("question_id", "rank", "vec_key", "score")
    assert found(ranked) == brute(data)


@BLOCKS
def test_ivf(tables, data, block):
    questions, vectors = tables
    centroids = ivf.train_centroids(vectors)
    assert centroids.shape == (ivf.cell_count(N), DIM) == (20, DIM)
    assigned = ivf.assign_cells(vectors, centroids)
    cell = np.argmax(np.round(data @ centroids.T, 6), axis=1)
    for nprobe in (1, 3):
        near = np.argsort(-np.round(data[:Q] @ centroids.T, 6), axis=1, kind="stable")[:, :nprobe]
        hits = ivf.search_ivf(questions, assigned, centroids, K, nprobe, block_questions=block)
        assert found(hits) == brute(data, lambda q, v: cell[v] in near[q])
    everything = ivf.search_ivf(questions, assigned, centroids, K, len(centroids), block_questions=block)
    assert found(everything) == brute(data)


@BLOCKS
def test_lsh(tables, data, tmp_path, block):
    signs = np.round(data @ lsh.directions(4, 5, DIM).T, 9) >= 0
    buckets = signs.reshape(N, 4, 5)
    hits = lsh.search_lsh(*tables, K, tables=4, bits=5, block_questions=block)
    want = brute(data, lambda q, v: (buckets[q] == buckets[v]).all(axis=1).any())
    assert found(hits) == want
    lsh.write_buckets(tables[1], str(tmp_path / "b"), tables=4, bits=5)
    assert found(lsh.search_buckets(tables[0], str(tmp_path / "b"), K, block_questions=block)) == want


def test_bits_follow_the_number_of_vectors():
    assert [lsh.bits_for(n) for n in (0, 100, 200, 100_000, 10**12)] == [1, 1, 1, 10, 20]


def test_stored_cells_are_searched_without_training(tables, data, tmp_path, monkeypatch):
    questions, vectors = tables
    spark = vectors.sparkSession
    centroids = ivf.train_centroids(vectors)
    vector_store.write_centroids(ivf.centroid_rows(spark, centroids), str(tmp_path / "c"))
    vector_store.write_vectors(ivf.assign_cells(vectors, centroids), str(tmp_path / "v"))
    monkeypatch.setattr(search, "train_centroids", None)
    stored, read = vector_store.read_vectors(spark, str(tmp_path / "v")), vector_store.read_centroids(spark, str(tmp_path / "c"))
    hits = search.search(questions, stored, K, "ivf", centroids=read, nprobe=len(centroids))
    assert found(hits) == brute(data)
    best = np.argmax(np.round(data @ centroids.T, 6), axis=1)
    assert {(r.vec_key, r.cell_id) for r in stored.collect()} == {(f"v{i:03d}", c) for i, c in enumerate(best)}


def test_cells_of_odd_vectors(spark, tables):
    questions, vectors = tables
    odd = [("z", [0.0] * DIM), ("n", [float("nan")] * DIM), ("m", None)]
    some = vectors.unionAll(spark.createDataFrame(odd, vectors.schema))
    centroids = ivf.train_centroids(some, cells=6)
    assert centroids.shape == (6, DIM) and np.isfinite(centroids).all()
    assert ivf.assign_cells(some, centroids).count() == N + 1
    nothing = vectors.limit(0)
    assert ivf.train_centroids(nothing).size == 0
    assert search.search(questions, nothing, K, "ivf").count() == 0
    with pytest.raises(ValueError, match="numbered"):
        ivf.collect_centroids(spark.createDataFrame([(1, [1.0])], "cell_id long, embedding array<double>"))


def test_unknown_numbers_take_no_place(spark, tables, data):
    questions, vectors = tables
    broken = [(f"n{i}", [float("nan")] + [1.0] * (DIM - 1)) for i in range(6)] + [("e", [None] + [1.0] * (DIM - 1)), ("f", [float("inf")] * DIM)]
    some = vectors.unionAll(spark.createDataFrame(broken, vectors.schema)).coalesce(1)
    asked = questions.unionAll(spark.createDataFrame([(99, [float("nan")] * DIM)], questions.schema))
    assert found(search.search(asked, some, K)) == brute(data)
    rows = search.search_one(some, data[4].tolist(), K).collect()
    assert {(4, i + 1, r.vec_key, r.score) for i, r in enumerate(rows)} == {h for h in brute(data) if h[0] == 4}


def test_building_a_search_reads_no_vectors_and_questions_once(spark, tables):
    questions, vectors = tables
    seen, asked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(rows, counter):
        def each(batches):
            for b in batches:
                counter.add(b.num_rows)
                yield b

        return rows.mapInArrow(each, rows.schema)

    hits = search.search(counted(questions, asked), counted(vectors.repartition(3), seen), K)
    assert seen.value == 0
    hits.collect()
    assert (seen.value, asked.value) == (N, Q)


def test_methods_and_recall(tables):
    exact = search.search(*tables, K, "flat")
    assert search.recall(exact, exact).agg(F.min("recall")).first()[0] == 1.0
    near = search.search(*tables, K, "ivf", nprobe=8)
    assert search.recall(near, exact).agg(F.avg("recall")).first()[0] > 0.8
    with pytest.raises(ValueError, match="Unknown index type"):
        search.search(*tables, K, "tree")


def test_single_question(tables, data):
    _, vectors = tables
    rows = search.search_one(vectors, data[4].tolist(), K).collect()
    assert {(4, i + 1, r.vec_key, r.score) for i, r in enumerate(rows)} == {h for h in brute(data) if h[0] == 4}


def test_few_vectors_and_odd_input(spark, tables):
    questions, vectors = tables
    assert search.search(questions, vectors.limit(3), K).count() == 3 * Q
    assert search.search(questions.limit(0), vectors, K).count() == 0
    nulls = vectors.withColumn("embedding", F.when(F.col("vec_key") < "v005", F.col("embedding")))
    assert search.search(questions, nulls, K).filter("rank = 1 and vec_key >= 'v005'").count() == 0
    ragged = vectors.unionAll(spark.createDataFrame([("x", [1.0, 2.0])], vectors.schema)).coalesce(1)
    with pytest.raises(Exception, match="same length"):
        search.search(questions, ragged, K).collect()


def test_normalised_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    units = [r.u for r in rows.select(l2_normalize(F.col("v")).alias("u")).collect()]
    assert units == [[0.6, 0.8], [0.0, 0.0]]
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert rows.select(score(F.col("v"), zero).alias("s")).first()["s"] == 0.0


def test_embedding(spark):
    texts = spark.createDataFrame([(1, "Dark matter, dark energy"), (2, "!!!"), (3, None)], "id long, text string")
    rows = {r.id: r.embedding for r in embedding.embed(texts, embedding.HashedWords(32)).collect()}
    wanted = np.zeros(32)
    for word in ("dark", "matter", "dark", "energy"):
        bucket, sign = embedding.word_position(word, 32)
        wanted[bucket] += sign
    assert set(rows) == {1, 2} and rows[2] == [0.0] * 32
    assert np.allclose(rows[1], wanted / np.linalg.norm(wanted))

    def load():
        return lambda batch: np.array([[len(t), 1.0] for t in batch])

    by_model = embedding.embed(texts, embedding.Model(load, batch_size=1)).orderBy("id").collect()
    assert np.allclose(by_model[0].embedding, np.array([24, 1]) / np.hypot(24, 1))


def test_only_new_texts_are_embedded(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "text string")
    stored = embedding.with_content_key(texts.filter("text = 'a'"))
    new = embedding.embed_new(texts, stored, embedding.HashedWords(8))
    assert new.count() == 2
    assert embedding.embed_new(texts, stored.select("content_key").union(new.select("content_key")), embedding.HashedWords(8)).count() == 0


class _Bounded:
    """An embedder that refuses more than it may hold at a time."""

    def prepare(self, text):
        return text

    def open(self):
        def embed(texts):
            assert len(texts) <= embedding.PIECE_ROWS and texts.nbytes <= 2 * embedding.PIECE_BYTES
            return np.array([[len(t), 1.0] for t in texts.to_pylist()])

        return embed


@pytest.mark.parametrize("rows, length", [(3 * embedding.PIECE_ROWS, 5), (60, 1 << 20)])
def test_texts_are_embedded_in_bounded_pieces(spark, rows, length):
    """However many texts a task has, and however long they are."""
    texts = spark.range(0, rows, 1, 1).select("id", F.repeat(F.lit("x"), length).alias("text"))
    found = embedding.embed(texts, _Bounded()).selectExpr("count(DISTINCT id)", "min(embedding[1])").first()
    assert found[0] == rows and found[1] == pytest.approx(1 / np.hypot(length, 1))


def test_new_texts_are_embedded_in_bounded_pieces(spark):
    """Also where the new texts meet in a few partitions."""
    texts = spark.range(0, 4 * embedding.PIECE_ROWS).select(F.concat(F.lit("text "), "id").alias("text")).coalesce(1)
    none = spark.createDataFrame([], "content_key string, embedding array<float>")
    new = embedding.embed_new(texts.union(texts), none, _Bounded())
    assert new.count() == 4 * embedding.PIECE_ROWS == new.select("content_key").distinct().count()


def test_positions_of_words_are_those_of_each():
    words = ["a", "b", "straße", "漢字", ""]
    bucket, sign = embedding.word_positions(words, 97)
    assert list(zip(bucket, sign)) == [embedding.word_position(w, 97) for w in words]
    assert embedding.word_positions([], 97)[0].shape == (0,)
