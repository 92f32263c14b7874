"""Rules on whole documents, and removal of lines that many documents of a host share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import batches, texts, written

#: Bytes between words, symbols that count, limits of the base rules.
WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT = 50, 50

DIGITS = re.compile(rb"[0-9]+")
STATS = "doc_id long, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
LINES = "doc_id long, text_hash long, host string, line_hash long, line_words long"
#: Parts that the rows of one common line are dealt to.
SALTS = 16


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words that is found more than once."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    pairs = np.unique(codes[:-1] * len(known) + codes[1:], return_inverse=True)[1]
    _, at, count = np.unique(pairs[:-1] * len(known) + codes[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[at] > 1)
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[starts + shift] = True
    return int(covered.sum())


def document_stats(text: str) -> tuple[int, int, int, int, int]:
    b = text.encode()
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    chars = len(text) - (len(b) - len(b.translate(None, WHITE)))
    return len(words), chars, len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def normal_line(line: bytes) -> bytes:
    """A line without regard to case, digits and white space; empty if it has no word."""
    return DIGITS.sub(b"0", b" ".join(line.decode().lower().encode().split()))


def line_hashes(text: str) -> list[int | None]:
    """Signed 64-bit hash of each ``\\n``-split line, None without a word."""
    found = []
    for line in text.encode().split(b"\n"):
        normal = normal_line(line)
        found.append(xxhash.xxh3_64_intdigest(normal) - 2**63 if normal else None)
    return found


def _line_rows(text: str) -> list[tuple[int, int]]:
    """``(hash, words)`` of each distinct line."""
    words: dict[int, int] = {}
    for line, h in zip(text.split("\n"), line_hashes(text)):
        if h is not None:
            words[h] = words.get(h, 0) + len(line.encode().split())
    return list(words.items())


def _keyed(docs: DataFrame) -> DataFrame:
    rows = texts(docs, F.coalesce(F.col("source"), F.lit("")).alias("host"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "host")


def stats(docs: DataFrame) -> DataFrame:
    """The base figures of each row of ``docs``."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            found = np.array([document_stats(t) for t in b[2].to_pylist()], np.int64).reshape(-1, 5)
            yield pa.record_batch(
                [b[0], b[1], *(pa.array(found[:, k]) for k in range(5))],
                ["doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
            )

    return _keyed(docs).mapInArrow(each, STATS)


def lines(docs: DataFrame) -> DataFrame:
    """The distinct lines with a word of each row of ``docs``."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            found = [_line_rows(t) for t in b[2].to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            flat = np.array([x for rows in found for x in rows], np.int64).reshape(-1, 2)
            yield pa.record_batch(
                [*(b[k].take(pa.array(at)) for k in (0, 1, 3)), *(pa.array(flat[:, k]) for k in range(2))],
                ["doc_id", "text_hash", "host", "line_hash", "line_words"],
            )

    return _keyed(docs).mapInArrow(each, LINES)


#: A line is common on a host if it is in more documents than this, and than this share of them.
MIN_DOCUMENTS, MIN_SHARE = 5, 0.05


def common_lines(rows: DataFrame, min_documents: int, min_share: float) -> DataFrame:
    """``(host, line_hash)`` of lines in more documents of a host than the limits allow.

    ``rows`` are those of ``lines``. Documents of a host with the same text are one document, where
    a line is counted and where the host is. The limit of a host is ``min_documents`` or the
    share ``min_share`` of its documents with a word, whichever is more.
    """
    counted = rows.groupBy("host", "line_hash").agg(F.count_distinct("text_hash").alias("documents"))
    hosts = rows.groupBy("host").agg(F.count_distinct("text_hash").alias("of_host"))
    often = counted.where(F.col("documents") > min_documents)
    limited = often.join(hosts, "host").where(F.col("documents") > min_share * F.col("of_host"))
    return limited.select("host", "line_hash")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def judge(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE, least_left: float = 0.3
) -> DataFrame:
    """One row per row of ``docs``: its figures, the verdict and ``common``, its common lines.

    ``base_failed``: under 50 words, or more than half of the words in repeated windows.
    ``kept``: not failed, and at least ``least_left`` of its words stand in lines that are not
    common on its host (``source``; null: the empty host). Null and empty texts have no words and
    fail. Repeated rows are judged alike, one by one; rows that share an id are judged by their texts.
    A line at a limit is not common. Very long texts are judged whole, in memory one by one. Other
    columns are left out, so their names cannot clash. An empty table gives no rows.
    """
    seen = written(lines(docs), "lines")
    often = common_lines(seen, min_documents, min_share).select(
        "host", "line_hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    hit = seen.withColumn("salt", F.pmod(F.xxhash64("text_hash"), F.lit(SALTS)).cast("int")).join(
        often, ["host", "line_hash", "salt"]
    )
    # At most the distinct lines of one document.
    of = hit.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("line_hash", "line_words")).alias("found"))
    base = stats(docs)
    lost = F.coalesce(F.aggregate("found", F.lit(0).cast("long"), lambda n, x: n + x["line_words"]), F.lit(0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    joined = base.join(of, _same(base, of), "left").select(base["*"], "found")
    return joined.select(
        "doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("n_words") - lost >= least_left * F.col("n_words"))).alias("kept"),
        lost.alias("common_words"),
        F.coalesce(F.transform("found", lambda x: x["line_hash"]), F.array().cast("array<bigint>")).alias("common"),
    )


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that are kept, without their common lines.

    Columns of ``docs`` stay as they are but for ``text`` and, if there is one, ``n_chars``.
    """
    verdicts = judge(docs, **limits).where("kept").select("doc_id", "text_hash", "common").dropDuplicates(["doc_id", "text_hash"])
    names = docs.columns
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    kept = keyed.join(verdicts, _same(keyed, verdicts)).select("row", "common")

    @F.pandas_udf("string")
    def without(text, common):
        return text.combine(common, lambda t, c: _without(t, set(c)) if len(c) else t)

    text = F.when(F.size("common") > 0, without(F.col("row.text"), F.col("common"))).otherwise(F.col("row.text"))
    kept = kept.select("row", text.alias("new_text"))
    changed = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return kept.select(*(changed.get(n, F.col(f"row.`{n}`")).alias(n) for n in names))


def _without(text: str, common: set[int]) -> str:
    return "\n".join(x for x, h in zip(text.split("\n"), line_hashes(text)) if h not in common)
