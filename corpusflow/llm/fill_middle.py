"""Fill-in-the-middle: documents cut in three, their parts in another order between marks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import batches, texts

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Of 100 documents so many are cut, and of 100 that are cut so many have the suffix first.
CUT, SUFFIX_FIRST = 90, 20
CUTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string"


class Exceptions:
    """Where the characters of a UTF-8 buffer are that take more than one byte, and no others.

    ``at`` has the byte positions of their first bytes, ``extra`` the bytes beyond one of all
    characters up to and with each. Spans between them are ASCII: there a code point is a byte.
    """

    def __init__(self, raw: np.ndarray):
        self.at = np.flatnonzero(raw >= 0xC0)
        lead = raw[self.at]
        self.extra = np.r_[0, np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))]
        #: Code points before each of them.
        self.point = self.at - self.extra[:-1]

    def points(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte position (at the edge of a character)."""
        return byte - self.extra[np.searchsorted(self.at, byte, "left")]

    def bytes(self, point: np.ndarray) -> np.ndarray:
        """Byte position of each code-point position."""
        return point + self.extra[np.searchsorted(self.point, point, "left")]


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32: the first digit groups of the hex SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int = 1, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Each row of ``docs`` with its parts in their new order: the columns ``CUTS``.

    Cuts are drawn in code points by the document's id, so that every run and every machine cuts
    alike. ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or
    ``plain`` for texts that stay as they are: empty ones, those that hold a mark and those that
    the draw leaves whole; their cuts are null. Each batch is cut as one UTF-8 buffer with one
    index of ``Exceptions``, and only the parts of documents are copied.

    Null texts count as empty. A null id draws as an empty one; rows that share an id and a
    length share their cuts, and repeated rows stay rows of their own. Very long texts are cut
    like others; a text goes through memory whole. Other columns are left out, so their names
    cannot clash. An empty table gives no rows.
    """
    held = F.lit(False)
    for mark in MARKS:
        held = held | F.contains(F.col("text"), F.lit(mark))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    rows = texts(docs).select(
        "doc_id", "text", h1.alias("h1"), h2.alias("h2"),
        (~held & (F.length("text") > 0) & (h3 % 100 < cut)).alias("cut"), (h4 % 100 < suffix_first).alias("spm"),
    )
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), *((c, pa.int64()) for c in ("prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes")), ("output", pa.string())]
    )
    prefix, suffix, middle = (m.encode() for m in MARKS)

    def arrange(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            text = pa.concat_arrays([b["text"]]).cast(pa.large_string())
            raw = text.buffers()[2]
            edge = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = memoryview(raw) if raw is not None else memoryview(b"")
            index = Exceptions(np.frombuffer(data, np.uint8, edge[-1]))
            point = index.points(edge)
            n = np.diff(point)
            drawn = [b[h].to_numpy(zero_copy_only=False) % (n + 1) for h in ("h1", "h2")]
            first, last = np.minimum(*drawn), np.maximum(*drawn)
            a, z = index.bytes(point[:-1] + first), index.bytes(point[:-1] + last)
            cut_, spm = b["cut"].to_numpy(zero_copy_only=False), b["spm"].to_numpy(zero_copy_only=False)
            parts: list = []
            sizes = np.diff(edge)
            for i, (lo, p, m, hi) in enumerate(zip(edge[:-1].tolist(), a.tolist(), z.tolist(), edge[1:].tolist())):
                if not cut_[i]:
                    parts.append(data[lo:hi])
                elif spm[i]:
                    parts += (suffix, data[m:hi], prefix, data[lo:p], middle, data[p:m])
                else:
                    parts += (prefix, data[lo:p], suffix, data[m:hi], middle, data[p:m])
            ends = np.r_[0, np.cumsum(sizes + cut_ * len(prefix + suffix + middle))]
            out = pa.Array.from_buffers(pa.large_string(), len(b), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(parts))])
            form = np.where(cut_, np.where(spm, "spm", "psm"), "plain")
            figures = [pa.array(x, pa.int64(), mask=~cut_) for x in (first, last - first, a - edge[:-1], z - a)]
            yield pa.record_batch([b["doc_id"], pa.array(n), pa.array(form, pa.string()), *figures, out.cast(pa.string())], schema=schema)

    return rows.mapInArrow(arrange, CUTS)


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` has put in another order, from its output alone.

    A cut text holds no mark, so the first mark of each kind behind the one before is the one that
    was put in.
    """

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + len(MIDDLE) + 1)

    p1, s1, m1 = between(PREFIX, SUFFIX)
    s2, p2, m2 = between(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(p1, m1, s1)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)
