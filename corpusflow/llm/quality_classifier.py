"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import batches, texts, written
from corpusflow.llm.quality_rules import WHITE, repeated_words

#: Labelled rows that a model is fitted on at most; more are thinned by a hash of their id.
LABELLED_ROWS = 200_000
#: Tasks that sum the normal equations, each with one matrix of WAVES x WAVES numbers.
FIT_TASKS = 16
WAVES = 400
#: Width of the kernel, in standard deviations of all statistics taken together.
WIDTH = 0.6
RIDGE = 1e-3
#: Raw scores between -1 and 2 are counted in so many steps for the calibration.
STEPS = 1500

CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = b"abcdefghijklmnopqrstuvwxyz"
SETS = (CAPITALS, b"0123456789", b"#*$%&", b"|<>{}[]\\^~=_@", b"!", b",;:", b".?", b"/-+()", SMALL)


def statistics(text: str) -> list[float]:
    """Figures of one whole text; an empty one has zeros."""
    b = text.encode()
    words, lines = b.split(), [x for x in b.split(b"\n") if x.strip()]
    if not words:
        return [0.0] * N_STATISTICS
    n, chars = len(words), len(text)
    count = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    line_words = np.array([x.count(b" ") + 1 for x in lines])
    shares = [(len(b) - len(b.translate(None, s))) / len(b) for s in SETS]
    known = np.fromiter(count.values(), np.int64, len(count))
    ends = sum(x.rstrip()[-1:] in b".!?\"'" for x in lines) / len(lines)
    entropy = -float((known / n * np.log(known / n)).sum())
    return [
        np.log1p(n), np.log1p(chars), lengths.mean(), np.log1p(lengths.std()), np.log1p(lengths.max()),
        *np.sqrt(shares), (len(b) - chars) / len(b), (len(b) - len(b.translate(None, WHITE))) / len(b),
        len(count) / n, known.max() / n, entropy, entropy / np.log(n + 1),
        repeated_words(words) / n, 1 - len(set(lines)) / len(lines), np.log1p(line_words.mean()),
        np.log1p(line_words.std()), (line_words < 4).mean(), ends, len(zlib.compress(b, 1)) / len(b),
        (lengths == 1).mean(), (lengths > 12).mean(),
    ]


N_STATISTICS = len(statistics("word"))


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, fold, x)``: the remainder of crc32 of the id as text by 5, and the statistics."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            x = [statistics(t) for t in b[1].to_pylist()]
            yield pa.record_batch([b[0], b[2], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "fold", "x"])

    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)).cast("int").alias("fold")
    return texts(docs, fold).mapInArrow(each, "doc_id long, fold int, x array<double>")


def pooled(steps: np.ndarray, count: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Isotonic means of neighbouring steps: pools those that fall until none does."""
    blocks: list[list[float]] = []
    for n, y in zip(count, positive):
        blocks.append([y, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y, n, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y, blocks[-1][1] + n, blocks[-1][2] + k]
    return np.repeat([y / n for y, n, _ in blocks], [int(k) for *_, k in blocks])


class Model:
    """What scores a row of statistics: scales, waves, weights and the calibration."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, 1 / np.where(spread > 1e-9, spread, 1)
        width = WIDTH * np.sqrt(len(mean))
        self.waves = rng.normal(size=(len(mean), WAVES)) / width
        self.phase = rng.uniform(0, 2 * np.pi, WAVES)
        self.weights = np.zeros(WAVES + 1)
        self.steps, self.levels = np.zeros(1), np.full(1, 0.5)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) * self.scale, -8, 8)
        waves = np.sqrt(2 / WAVES) * np.cos(z @ self.waves + self.phase)
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -1, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth goes to the raw score, which parts the ties within a pool."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.steps, self.levels) + 0.001 * (raw + 1) / 3, 0, 1)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, N_STATISTICS))


def train(rows: DataFrame, labels: DataFrame) -> Model | None:
    """A model of ``labels.quality``, from statistics of rows whose fold is not 0; None without any.

    Folds 2 to 4 fit the weights, fold 1 the calibration. Labels that repeat are averaged, null
    ones left out. Each task adds up ``Z'Z`` and ``Z'y`` of its rows; sums meet by matrix row.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    labelled = rows.where("fold != 0").join(known, "doc_id")
    seen = written(labelled.select("doc_id", "fold", "x", "y"), "labelled")
    count = seen.count()
    if not count:
        return None
    if count > LABELLED_ROWS:
        seen = seen.where(F.pmod(F.xxhash64("doc_id"), F.lit(count)) < LABELLED_ROWS)
    some = [F.element_at("x", i + 1) for i in range(N_STATISTICS)]
    moments = seen.agg(*(F.avg(c) for c in some), *(F.stddev_pop(c) for c in some)).first()
    model = Model(np.array(moments[:N_STATISTICS]), np.array(moments[N_STATISTICS:]))
    size = WAVES + 1

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in it:
            z = model.features(matrix(b.column(0)))
            total += z.T @ np.hstack([z, np.asarray(b.column(1))[:, None]])
        yield pa.record_batch([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    def add(t: pa.Table) -> pa.Table:
        whole = np.asarray(t["sums"].combine_chunks().flatten()).reshape(len(t), -1).sum(axis=0)
        return pa.table({"i": t["i"].slice(0, 1), "sums": pa.array([whole], pa.list_(pa.float64()))})

    fitting = seen.where("fold != 1").select("x", "y").coalesce(FIT_TASKS)
    parts = fitting.mapInArrow(sums, "i int, sums array<double>").groupBy("i").applyInArrow(add, "i int, sums array<double>")
    found = sorted(parts.collect())  # one row per wave
    total = np.array([r["sums"] for r in found]).reshape(size, size + 1)
    penalty = RIDGE * max(total[-1, -2], 1) * np.eye(size)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(total[:, :size] + penalty, total[:, size])

    def steps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            step = np.rint((model.raw(matrix(b.column(0))) + 1) / 3 * STEPS).astype(np.int32)
            yield pa.record_batch([pa.array(step), b.column(1)], ["step", "y"])

    counted = seen.where("fold = 1").select("x", "y").mapInArrow(steps, "step int, y double")
    counted = sorted(counted.groupBy("step").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect())
    if counted:
        at, n, y = (np.array(c, float) for c in zip(*counted))
        model.steps, model.levels = at / STEPS * 3 - 1, pooled(at, n, y)
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row of ``docs``.

    Rows of fold 0 are held out: their labels are never read. Null texts count as empty; rows
    without an id are not held out. Without any label every score is 0.5.
    """
    rows = written(document_statistics(docs), "statistics")
    model = train(rows, labels)

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            scores = model.score(matrix(b.column(2))) if model else np.full(b.num_rows, 0.5)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(scores)], ["doc_id", "fold", "score"])

    scored = rows.mapInArrow(each, "doc_id long, fold int, score double")
    held_out = F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
