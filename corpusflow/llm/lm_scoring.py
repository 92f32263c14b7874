"""Stupid-backoff scores of documents under n-gram counts of the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import batches, mixed, runs, texts

#: Text in bytes that one task counts and scores at a time.
CHUNK_BYTES = 12_000_000
BACKOFF = 0.4


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, small ones in few bytes: bytes of equal weight side by side."""
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


class Grams:
    """Hashed n-grams of the compressed documents of a chunk: ``keys[n - 1]`` by their last word.

    n-grams do not cross documents. Equal 64-bit hashes count as equal n-grams.
    """

    def __init__(self, column: Sequence[bytes], order: int):
        known: dict[bytes, int] = {}
        plain = zstandard.ZstdDecompressor().decompress
        parts = [np.fromiter((known.setdefault(w, len(known)) for w in plain(t).split()), np.int32) for t in column]
        self.length = np.array([len(p) for p in parts], np.int64)
        words = np.array([xxhash.xxh3_64_intdigest(w) for w in known], np.uint64)
        words = words[np.concatenate(parts)] if parts else np.zeros(0, np.uint64)
        del parts
        starts = np.repeat(np.cumsum(self.length) - self.length, self.length)
        self.place = (np.arange(len(words)) - starts).astype(np.int32)
        self.keys: list[np.ndarray] = []
        gram = np.zeros(len(words), np.uint64)
        for n in range(1, order + 1):
            # The n-gram that ends at a word: the one before it that ends a word earlier, and the word.
            before = np.r_[np.zeros(1, np.uint64), gram[:-1]] if n > 1 else gram
            gram = mixed(before * np.uint64(0x9E3779B97F4A7C15) + words, n)
            self.keys.append(gram)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys of the chunk in ascending order, and how often each occurs.

        The first is 0, the empty n-gram, which occurs once per word.
        """
        every = np.concatenate([k[self.place >= n] for n, k in enumerate(self.keys)])
        every.sort()
        first, count = runs(every)
        return np.r_[np.zeros(1, np.uint64), every[first]], np.r_[len(self.place), count]

    def spread(self, counts: np.ndarray) -> list[np.ndarray]:
        """The counts of the n-grams that end at each word, given those of ``distinct``.

        n-grams that cross documents count as 0.
        """
        inside = [self.place >= n for n in range(len(self.keys))]
        every = np.concatenate([k[i] for k, i in zip(self.keys, inside)])
        self.keys = []  # not needed any more
        order = np.argsort(every)
        _, length = runs(every[order])
        del every
        whole = np.empty(len(order))
        whole[order] = np.repeat(counts[1:], length)
        spread, at = [np.full(len(self.place), counts[0] if len(counts) else 0.0)], 0
        for i in inside:
            own = np.zeros(len(i))
            own[i] = whole[at : at + np.count_nonzero(i)]
            at += np.count_nonzero(i)
            spread.append(own)
        return spread


def log_scores(grams: Grams, counts: list[np.ndarray], min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the score of each word, and the length of the n-gram that it rests on.

    ``counts[n]`` are the corpus counts of the n-grams that end at each word. The longest n-gram
    with at least ``min_count`` occurrences decides; each step down costs a factor ``BACKOFF``.
    """
    order = len(counts) - 1
    longest = np.minimum(grams.place + 1, order)
    score, used = np.zeros(len(grams.place)), np.zeros(len(grams.place), np.int64)
    for n in range(order, 0, -1):
        fits = (used == 0) & (longest >= n) & ((counts[n] >= min_count) | (n == 1))
        context = counts[n - 1] if n == 1 else np.r_[1, counts[n - 1][:-1]]
        score[fits] = np.log(counts[n][fits] / context[fits]) + (longest[fits] - n) * np.log(BACKOFF)
        used[fits] = n
    return score, used


def _small(rows: DataFrame) -> DataFrame:
    """``text`` compressed as ``data``, to be shuffled."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches(it):
            data = pa.array([pack(t.encode()) for t in b[2].to_pylist()], pa.binary())
            yield pa.record_batch([b[0], b[1], data], ["chunk", "doc_id", "data"])

    return rows.mapInArrow(each, "chunk int, doc_id long, data binary")


def score(docs: DataFrame, order: int = 3, min_count: int = 2) -> DataFrame:
    """``(doc_id, n_words, log_score, mean_log_score, n_backed_off)`` of each row of ``docs``.

    Words are parted by ASCII white space. Texts are dealt to chunks of bounded size by the hash
    of their id. Each chunk sends its distinct n-grams with their counts, parted by ranges of
    their hash; each range adds up and answers every chunk with the counts of the n-grams it sent, in
    their order; each chunk joins these to its n-grams and adds up the words of each document.
    A frequent n-gram is one row of each chunk, so there is no hot key. Null and empty texts
    have no words and a score of 0, with a null mean. Repeated rows count and score one by one.
    """
    rows = texts(docs).select("doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 1
    chunks = -(-size // CHUNK_BYTES)
    bits = max(0, int(chunks - 1).bit_length())
    chunk = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).cast("int")
    dealt = _small(rows.select(chunk.alias("chunk"), "doc_id", "text")).repartition(max(1, int(chunks)), "chunk")

    def ranges(keys: np.ndarray) -> list[int]:
        """Where each range of hashes begins, and the end."""
        if not bits:
            return [0, len(keys)]
        bounds = np.arange(1, 2**bits, dtype=np.uint64) << np.uint64(64 - bits)
        return [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]

    def count(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        keys, found = Grams(t["data"].to_pylist(), order).distinct()
        at = ranges(keys)
        own = [(r, a, b) for r, (a, b) in enumerate(zip(at, at[1:])) if b > a]
        return pa.table(
            {
                "range": pa.array([r for r, *_ in own], pa.int32()),
                "chunk": pa.array([key[0].as_py()] * len(own), pa.int32()),
                "grams": pa.array([packed(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in own], pa.binary()),
                "counts": pa.array([packed(found[a:b]) for _, a, b in own], pa.binary()),
            }
        )

    def total(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(x), dtype=np.uint64) for x in t["grams"].to_pylist()]
        counts = np.concatenate([unpacked(x) for x in t["counts"].to_pylist()])
        every = np.concatenate(keys)
        order_ = np.argsort(every, kind="stable")
        first, length = runs(every[order_])
        sums = np.add.reduceat(counts[order_], first)
        whole = np.empty(len(every), np.uint64)
        whole[order_] = np.repeat(sums, length)
        parts = np.split(whole, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"chunk": t["chunk"], "range": t["range"], "counts": pa.array([packed(p) for p in parts], pa.binary())})

    def join(key: tuple[pa.Scalar, ...], t: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(t["data"].to_pylist(), order)
        answers = answers.sort_by("range")
        counts = [unpacked(x) for x in answers["counts"].to_pylist()]
        counts = np.concatenate(counts).astype(np.float64) if counts else np.zeros(0)
        own = grams.spread(counts)
        logs, used = log_scores(grams, own, min_count)
        ends = np.cumsum(grams.length)
        starts = ends - grams.length
        back = np.r_[0, np.cumsum(used < np.minimum(grams.place + 1, order))]
        # Sums over each document on its own, so that they do not hang on what else is in the chunk.
        of = np.array([logs[a:b].sum() for a, b in zip(starts, ends)])
        mean = pa.array(of / np.maximum(grams.length, 1), mask=grams.length == 0)
        return pa.table(
            {"doc_id": t["doc_id"], "n_words": grams.length, "log_score": of, "mean_log_score": mean, "n_backed_off": back[ends] - back[starts]}
        )

    sent = dealt.groupBy("chunk").applyInArrow(count, "range int, chunk int, grams binary, counts binary")
    answers = sent.groupBy("range").applyInArrow(total, "chunk int, range int, counts binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        join, "doc_id long, n_words long, log_score double, mean_log_score double, n_backed_off long"
    )
