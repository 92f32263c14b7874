"""Best-fit packing of tokenised documents into sequences under several capacities."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import batches, part, texts, written

#: Bytes of the words that a task keeps with their ids, before it begins again without any.
CACHE_BYTES = 32 << 20
#: Bytes of an entry besides the word's characters and ids: two objects and a place in the table.
ENTRY_BYTES = 180
#: Bytes of texts that are worked on at a time.
TEXTS_BYTES = 4 << 20
#: Fixed value: a special token of the vocabulary.
MARK = "<|endoftext|>"
#: Latin letters whose lower case is one letter each, then signs that form one pre-token.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+"
LETTERS_SIGNS = f"^(?P<letters>{LETTERS})(?P<signs>[.,!?#$%&*;:|]*)$"
LATIN = re.compile(LETTERS.replace("A-Z", ""))
#: Texts that tell whether a tokenizer works word by word.
PROBES = (
    "Plain words, in a row. And more", "two  spaces\nlines\n\nÉtude naïve Straße ÑANDÚ", "don't we'll I'M o'clock (a) [b] #c $5 %x",
    "x=1;y=22 3.14 a-b_c/d\\e", " lead and trail ", "1,000 2nd v2.0", "漢字 かな 😀 e\u0301 \u00a0x\ty\r\nz", "end.\nNew... \"q\" <b>", "word", "",
)
#: Pieces that one task packs at a time. Each such group leaves about one sequence part-filled.
GROUP_PIECES = 16_384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of whole texts, word by word.

    For tokenizers whose pre-tokenizer never joins characters across a space or line feed and
    parts letters from signs. The words between spaces are numbered in Arrow, and only different
    ones are looked at: a word of plain letters and closing signs is put together from the ids of
    both, its letters in lower case if the tokenizer ignores case. Whether a tokenizer is of this
    kind is tried on ``PROBES``; texts go whole to any other (``by_word`` is false).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(MARK)
        # How the pre-tokenizer writes letters beyond ASCII, each by itself.
        before = self.tokenizer.pre_tokenizer
        self.written = {k: "".join(x for x, _ in before.pre_tokenize_str(chr(k))) for k in range(0xC0, 0x17F)} if before else {}
        probes = pa.array(PROBES)
        whole, edges = self.whole(probes)
        for self.lower in (True, False):
            self.known: dict[str, bytes] = {}
            self.size = 0
            try:
                ids, cuts = self.looked_up(probes)
            except ValueError:
                self.by_word = False
            else:
                self.by_word = np.array_equal(ids, whole) and np.array_equal(cuts, edges)
            if self.by_word:
                break

    def whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are encoded as they are, and where those of each text begin and end."""
        found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(column.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u4"), *found]), np.r_[0, np.cumsum([len(f) for f in found], dtype=np.int64)]

    def keep(self, word: str, ids: bytes) -> None:
        self.known[word] = ids
        self.size += ENTRY_BYTES + len(word) + len(ids)

    def encode(self, words: list[str]) -> None:
        """Encode words, many at once with a special token between them."""
        plain = [w for w in words if "<|" not in w] if self.mark is not None else []
        for i in range(0, len(plain), 64):
            some = plain[i : i + 64]
            ids = np.array(self.tokenizer.encode(MARK.join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(some) - 1:
                raise ValueError(f"{MARK} does not stand between all words")
            for w, a, b in zip(some, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]):
                self.keep(w, ids[a:b].tobytes())
        rest = [w for w in words if w not in self.known]
        for w, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
            self.keep(w, np.array(e.ids, "<u4").tobytes())

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of different words. Those of Latin letters go to the merges right away."""
        if self.size > CACHE_BYTES:
            self.known, self.size = {}, 0
        new = [w for w in words if w not in self.known]
        merge, latin, others = self.tokenizer.model.tokenize, LATIN.fullmatch, []
        for w in new:
            if latin(w):
                found = merge(w if w.isascii() else w.translate(self.written))
                self.keep(w, struct.pack(f"<{len(found)}I", *(t.id for t in found)))
            else:
                others.append(w)
        self.encode(others)
        return list(map(self.known.__getitem__, words))

    def looked_up(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        found = pc.extract_regex(words, LETTERS_SIGNS)
        letters, signs = (pc.struct_field(found, k) for k in ("letters", "signs"))
        heads = pc.if_else(found.is_valid(), pc.utf8_lower(letters) if self.lower else letters, words).dictionary_encode()
        tails = pc.if_else(found.is_valid(), signs, "").dictionary_encode()
        ids = self.ids_of(heads.dictionary.to_pylist()) + self.ids_of(tails.dictionary.to_pylist())
        pool, size = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = np.cumsum(size) - size
        # Each word is a head and a tail in the pool.
        pieces = np.stack([heads.indices.to_numpy(), tails.indices.to_numpy() + len(heads.dictionary)], axis=1)[code].ravel()
        length = size[pieces]
        ends = np.cumsum(length)
        out = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[pieces] - (ends - length), length)]
        return out, np.r_[0, ends][2 * np.asarray(parts.offsets, np.int64)]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 32-bit ids of all texts of a column, and where those of each begin and end."""
        return self.looked_up(column) if self.by_word else self.whole(column)


def token_pieces(docs: DataFrame, tokenizer: str, sequence_tokens: int = 4096, end_id: int = 1) -> DataFrame:
    """Token pieces of each document: ``(doc_id, piece, start, length, ids_crc32)``.

    A document's ids and ``end_id`` are cut every ``sequence_tokens``. Null and empty texts are
    the end id alone; null ids of documents and repeated rows are kept as rows of their own. Very
    long texts are cut like others, and a text's ids are in memory whole. ``tokenizer`` is the path
    of any tokenizer file; see ``WordIds``. Other columns are left out, so their names cannot clash.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task is one thread; threads of the library's own would each keep memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of = WordIds(tokenizer)
        for b in batches(it, TEXTS_BYTES):
            found, edges = ids_of(b["text"])
            ends = edges[1:] + np.arange(b.num_rows)
            ids = np.insert(found, edges[1:], np.uint32(end_id)).astype("<u4")
            starts, rows = np.r_[0, ends[:-1] + 1][: b.num_rows], []
            data = memoryview(ids).cast("B")
            for doc, a, z in zip(b["doc_id"].to_pylist(), starts.tolist(), (ends + 1).tolist()):
                for k, at in enumerate(range(a, z, sequence_tokens)):
                    piece = data[4 * at : 4 * min(at + sequence_tokens, z)]
                    rows.append((doc, k, at - a, len(piece) // 4, zlib.crc32(piece)))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return texts(docs).mapInArrow(cut, PIECES)


def fit(demand: np.ndarray, capacity: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item and the tokens before it, longest items first.

    ``demand`` has a row per item: tokens, documents, attention cost. An item goes to the open
    bin, among those that hold it in every dimension, whose residual norm after it is least
    (``norm``) or whose residual has the largest dot product with it (``dot``); each
    dimension counts by its mean demand in units of capacity. Ties go to the oldest bin.
    """
    size = demand / capacity
    weight = size.mean(axis=0) / max(size.mean(axis=0).sum(), 1e-300)
    order = np.lexsort((np.arange(len(size)), -size[:, 0]))
    left = np.ones((len(capacity), len(size)))
    bins, before, used, count = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), 0
    live = np.zeros(len(size), np.int64)  # bins that may still hold something, oldest first
    n_live, least = 0, size[:, 0].min() if len(size) else 0
    w = weight[:, None]
    for i in order:
        s = size[i][:, None]
        here = live[:n_live]
        rest = left[:, here] - s
        fits = (rest > -1e-12).all(axis=0)
        if fits.any():
            if rule == "norm":
                score = np.where(fits, (w * rest * rest).sum(axis=0), np.inf)
            else:
                score = np.where(fits, -(w * (rest + s) * s).sum(axis=0), np.inf)
            b = here[int(score.argmin())]
        else:
            b, count = count, count + 1
            live[n_live] = b
            n_live += 1
        left[:, b] -= s[:, 0]
        bins[i], before[i] = b, used[b]
        used[b] += int(demand[i, 0])
        if n_live > 64 and n_live % 64 == 0:
            keep = live[:n_live][left[0, live[:n_live]] >= least - 1e-12]
            n_live = len(keep)
            live[:n_live] = keep
    return bins, before


def pack(
    pieces: DataFrame,
    sequence_tokens: int = 4096,
    sequence_documents: int = 1024,
    attention_cost: int = 4096 * 4096,
    rule: str = "norm",
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    A sequence holds at most ``sequence_tokens`` tokens, ``sequence_documents`` pieces and a sum
    of squared lengths of ``attention_cost``; one piece that breaks the last on its own gets a
    sequence of its own. Pieces are dealt by the hash of their row to groups of about
    ``GROUP_PIECES``, so that no key is hot and a group's size is bounded; full pieces need no
    packing. Sequence numbers are unique, not dense.
    """
    rows = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = (F.col("length") >= sequence_tokens) | (F.col("length") * F.col("length") >= attention_cost)
    full = rows.where(whole).select(*pieces.columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = rows.where(~whole)
    groups = max(1, -(-open_.count() // GROUP_PIECES))
    capacity = np.array([sequence_tokens, sequence_documents, attention_cost], float)

    def one(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        n = t["length"].to_numpy().astype(float)
        bins, before = fit(np.stack([n, np.ones(len(n)), n * n], axis=1), capacity, rule)
        t = t.drop_columns(["row", "packed_in"])
        return t.append_column("sequence_id", pa.array(key[0].as_py() * 2**32 + bins)).append_column("offset", pa.array(before))

    schema = f"{PIECES}, sequence_id long, offset long"
    packed = open_.withColumn("packed_in", part(F.col("row"), groups)).groupBy("packed_in").applyInArrow(one, schema)
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, sequence_tokens: int = 4096, **limits) -> DataFrame:
    """Tokenise and pack whole documents; see ``token_pieces`` and ``pack``."""
    return pack(token_pieces(docs, tokenizer, sequence_tokens), sequence_tokens, **limits)
