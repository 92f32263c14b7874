"""Texts to unit vectors, with a plug-in model or with hashed word counts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.vectors import DIMENSION, plain_words
from corpusflow.session import handed_over, small_batches
from corpusflow.sources import versioned

# Fixed value: texts per model call.
BATCH_SIZE = 128
# Texts that are embedded at a time, and bytes of them, by their mean length.
PIECE_ROWS, PIECE_BYTES = 16 * BATCH_SIZE, 8 << 20


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, as many at a time as an embedder may hold as matrices and word lists."""
    fitting = int(batch.num_rows * PIECE_BYTES / max(1, batch.nbytes))
    step = max(1, min(PIECE_ROWS, fitting))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def vectors_to_arrow(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.astype(np.float32).ravel()))


def arrow_to_vectors(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; all rows must have the same length."""
    if len(column) == 0:
        return np.zeros((0, 0))
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or (lengths != lengths[0]).any():
        raise ValueError("vectors must all have the same length")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), lengths[0])


def word_positions(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each word, from its MD5 digest: 32 bits and the bit that follows."""
    digests = b"".join(hashlib.md5(w.encode()).digest() for w in words)
    parts = np.frombuffer(digests, dtype=">u4").reshape(-1, 4)
    return (parts[:, 0] % width).astype(np.int64), np.where(parts[:, 1] < 1 << 31, 1.0, -1.0)


def word_position(word: str, width: int) -> tuple[int, float]:
    """The same for one word."""
    bucket, sign = word_positions([word], width)
    return int(bucket[0]), float(sign[0])


class HashedWords:
    """Counts of hashed words, signed and normalised. Needs no model.

    Words are cut in the JVM; each distinct word of a piece is hashed once.
    """

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def prepare(self, text):
        return plain_words(text)

    def open(self) -> Callable[[pa.Array], np.ndarray]:
        width = self.dimension

        def embed(texts: pa.Array) -> np.ndarray:
            encoded = texts.flatten().dictionary_encode()
            bucket, sign = word_positions(encoded.dictionary.to_pylist(), width)
            word = encoded.indices.to_numpy()
            text = np.repeat(np.arange(len(texts)), np.diff(texts.offsets.to_numpy()))
            counts = np.bincount(
                text * width + bucket[word], weights=sign[word], minlength=len(texts) * width
            )
            return counts.astype(np.float64).reshape(len(texts), width)

        return embed


class Model:
    """A model given as a factory of ``list[str] -> matrix``, loaded once per task."""

    def __init__(self, factory: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = BATCH_SIZE):
        self.factory = factory
        self.batch_size = batch_size

    def prepare(self, text):
        return text

    def open(self) -> Callable[[pa.Array], np.ndarray]:
        model, size = self.factory(), self.batch_size

        def embed(texts: pa.Array) -> np.ndarray:
            parts = [
                np.asarray(model(texts[i : i + size].to_pylist()), dtype=np.float64)
                for i in range(0, len(texts), size)
            ]
            return np.concatenate(parts) if parts else np.zeros((0, 0))

        return embed


def embed(texts: DataFrame, embedder: HashedWords | Model, text: str = "text") -> DataFrame:
    """Replace the text column by a unit-length ``embedding``; texts must not be null."""
    kept = [c for c in texts.columns if c != text]
    schema = T.StructType(
        [texts.schema[c] for c in kept] + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = embedder.open()
        for batch in batches:
            for piece in _pieces(batch):
                vectors = vectors_to_arrow(_unit_rows(model(piece.column("_input"))))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(c) for c in kept] + [vectors], names=[*kept, "embedding"]
                )

    small_batches(texts.sparkSession)
    prepared = texts.filter(F.col(text).isNotNull()).select(
        *kept, embedder.prepare(F.col(text)).alias("_input")
    )
    return prepared.mapInArrow(run, schema)


def with_content_key(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.withColumn("content_key", F.sha2(F.col(text), 256))


def embed_new(
    texts: DataFrame, stored: DataFrame, embedder: HashedWords | Model, text: str = "text"
) -> DataFrame:
    """Vectors, by content key, of the distinct texts that ``stored`` does not hold yet.

    Appending the result to the stored vectors makes a repeated or broken-off run go on
    where it stopped. Equal texts meet by their hash and are combined before the shuffle, so
    many copies of one text cost one row.
    """
    keyed = with_content_key(texts.select(text), text)
    # Keys alone say what is new; only the texts of these are then moved.
    new = keyed.select("content_key").distinct().join(stored.select("content_key"), "content_key", "left_anti")
    fetched = keyed.join(new, "content_key", "left_semi").groupBy("content_key").agg(F.first(text).alias(text))
    return embed(fetched, embedder, text)


def embed_sync(texts: DataFrame, path: str, embedder: HashedWords | Model) -> dict | None:
    """Bring the versioned table ``path`` in line with ``texts(vec_key, text)``, keys being distinct.

    Afterwards it holds ``(vec_key, content_key, embedding)`` of just these texts, as if it had been
    made from them. Keys and digests say what is new, changed or deleted; only new and changed texts
    are moved and embedded. If ``texts`` has a ``content_key`` already, other texts are not
    even read. All changes appear at once. Texts that are null have no vector. Returns the
    manifest; nothing is written if nothing has changed.
    """
    spark = texts.sparkSession
    if "content_key" not in texts.columns:
        texts = with_content_key(texts)
    texts = texts.select("vec_key", "content_key", "text").where("content_key IS NOT NULL")
    now = versioned.manifest(spark, path)
    stored = versioned.read_version(spark, path, ["vec_key", "content_key"]) if now else None
    changes = handed_over(versioned.differences(texts, stored, "vec_key", "content_key"), "changes")
    if now and changes.isEmpty():
        return now
    moved = changes.where("change != 'deleted'").select("vec_key")
    rows = embed(texts.join(moved, "vec_key", "left_semi"), embedder)
    return versioned.commit(rows, changes.where("change != 'new'"), path, ["vec_key"], based_on=now)
