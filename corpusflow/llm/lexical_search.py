"""Ranked lexical search over posting lists that are cut into blocks of like documents.

The index is a table with a row per segment, some thousand documents each. A segment has its
documents by term and its terms by document. The posting list of each frequent term is clustered
by the likeness of its documents, each cluster is a block, and a block stores the largest value of
each coordinate, a frequent term, among its documents. A search skips a block only if that summary
proves that none of its documents can be among the best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.llm.common import batches, small_batches, texts
from corpusflow.session import shared_folder

#: The bytes of a term, capitals A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_TERM = np.zeros(256, bool)
IN_TERM[48:58] = IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True

#: Fixed values of the score.
SCALE, TF_PART, M_PART, LEVEL, SLOPE = 1_000_000_000, 1000, 20, 50, 50
#: A value in a summary is rounded up to a multiple of this, so that it takes one byte.
STEP = 4096

#: Characters of a segment; the terms that have blocks and are coordinates; documents of a block.
SEGMENT_BYTES = 2_000_000
COORDINATES = 512
BLOCK = 64
#: Bits of a document's sketch, by which documents are compared.
SKETCH = 64
#: Bytes of a row group of the stored index.
GROUP_BYTES = 2 << 20

INDEX = (
    "terms array<string>, df binary, doc_ids array<bigint>, n binary, at binary, term binary, tf binary, "
    "list_at binary, list_docs binary, block_at binary, block_docs binary, block_owner binary, summary binary"
)
INDEX_SCHEMA = pa.schema(
    [("terms", pa.list_(pa.string())), ("df", pa.binary()), ("doc_ids", pa.list_(pa.int64()))]
    + [(c, pa.binary()) for c in ("n", "at", "term", "tf", "list_at", "list_docs", "block_at", "block_docs", "block_owner", "summary")]
)
KINDS = {
    "df": np.int32, "n": np.int64, "at": np.int64, "term": np.int32, "tf": np.int32, "list_at": np.int64, "list_docs": np.int32,
    "block_at": np.int64, "block_docs": np.int32, "block_owner": np.int32, "summary": np.uint8,
}


def _bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a column of texts, where each text begins, and where terms begin and end.

    A term begins where a byte of a term has none before it in the same text.
    """
    column = pa.concat_arrays([column]).cast(pa.large_string())
    edge = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data is not None and edge[-1] > edge[0] else np.zeros(0, np.uint8)
    edge = edge - edge[0]
    inside = np.zeros(len(raw) + 2, bool)
    np.take(IN_TERM, raw, out=inside[1:-1])
    change = inside[1:] != inside[:-1]
    places = np.flatnonzero(change)
    starts, ends = places[::2], places[1::2]
    # Terms that run on from one text into the next are two.
    cuts = edge[1:-1][(edge[1:-1] > edge[:-2]) & (edge[1:-1] < len(raw))]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    if len(cuts):
        starts, ends = np.sort(np.r_[starts, cuts]), np.sort(np.r_[ends, cuts])
    return raw, edge, starts, ends


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All terms of a column of texts in order, the text of each, and the number of each text."""
    raw, edge, starts, ends = _bounds(column)
    doc = np.searchsorted(edge, starts, "right") - 1
    # The bytes of terms alone, one term behind the other.
    offsets = np.r_[0, np.cumsum(ends - starts)]
    body = LOWER[raw[IN_TERM[raw]]]
    terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    return terms, doc, np.bincount(doc, minlength=len(column)).astype(np.int64)


def value(tf: np.ndarray, n: np.ndarray, corpus: tuple[int, int]) -> np.ndarray:
    """The part of a term's score that hangs on the document, for its count and the document's length."""
    docs, total = corpus
    m = 2 * LEVEL - SLOPE + (SLOPE * n * docs) // max(total, 1)
    return (SCALE * tf) // (TF_PART * tf + M_PART * m)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats: a row of each task is summed."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = total = 0
        for b in batches(it, SEGMENT_BYTES):
            n = terms_of(b["text"])[2]
            some, total = some + int(np.count_nonzero(n)), total + int(n.sum())
        yield pa.record_batch([pa.array([some]), pa.array([total])], ["docs", "total"])

    row = texts(docs).select("text").mapInArrow(count, "docs long, total long").agg(F.sum("docs"), F.sum("total")).first()
    return int(row[0] or 0), int(row[1] or 0)


def clusters(sketch: np.ndarray, docs: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """``docs`` in an order of like documents, and where its blocks of at most ``block`` begin.

    Evenly spaced documents of the list are the centres, each document goes to the centre whose
    sketch differs in the fewest bits, so whose angle is least; a cluster above the size is cut.
    """
    centres = sketch[docs[:: max(1, block // 2)]]
    nearest = np.bitwise_count(sketch[docs][:, None] ^ centres).argmin(axis=1)
    order = np.argsort(nearest, kind="stable")
    sizes = np.bincount(nearest)
    starts = np.cumsum(sizes) - sizes
    cuts = [np.arange(a, a + s, block) for a, s in zip(starts.tolist(), sizes.tolist()) if s]
    return docs[order], np.concatenate(cuts)


def segment(ids: pa.Array, column: pa.Array, corpus: tuple[int, int], coordinates: int, block: int) -> list:
    """A row of the index for some documents: the columns ``INDEX``.

    Terms are numbered by falling frequency. The first ones, at most ``coordinates`` and those
    alone whose lists fill two blocks, have blocks and are the coordinates of the summaries.
    """
    terms, doc, n = terms_of(column)
    coded = terms.dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = max(len(names), 1)
    key, tf = np.unique(doc * size + code, return_counts=True)
    doc, term = key // size, key % size
    df = np.bincount(term, minlength=len(names)).astype(np.int32)
    order = np.argsort(-df, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    names, df, term = names.take(pa.array(order)), df[order], rank[term]
    at = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(n)))]
    by_term = np.argsort(term, kind="stable")
    list_at, list_docs = np.r_[0, np.cumsum(df, dtype=np.int64)], doc[by_term]
    blocked = int(np.count_nonzero(df[:coordinates] >= 2 * block))
    v = value(tf, n[doc], corpus)
    dense = np.zeros((len(n), max(blocked, 1)), np.uint8)
    frequent = term < blocked
    dense[doc[frequent], term[frequent]] = np.minimum(-(-v[frequent] // STEP), 255)
    # A bit is the side of a random plane through the mean on which a document's values lie.
    signs = np.random.default_rng(1).integers(0, 2, (SKETCH, dense.shape[1])).astype(np.float32) * 2 - 1
    sides = np.einsum("dt,st->ds", dense.astype(np.float32) - dense.mean(axis=0, dtype=np.float32), signs) > 0
    sketch = np.packbits(sides, axis=1).view(np.uint64)[:, 0] if len(n) else np.zeros(0, np.uint64)
    block_at, block_docs, owner, summary, base = [np.zeros(1, np.int64)[:0]], [], [], [], 0
    for t in range(blocked):
        ordered, cuts = clusters(sketch, list_docs[list_at[t] : list_at[t + 1]], block)
        block_at.append(cuts + base)
        block_docs.append(ordered)
        owner.append(np.full(len(cuts), t))
        summary.append(np.maximum.reduceat(dense[ordered], cuts, axis=0))
        base += len(ordered)
    block_at.append(np.array([base]))
    # Lists with blocks are stored by block only.
    list_docs = list_docs[list_at[blocked] :]
    arrays = {
        "df": df, "n": n, "at": at, "term": term, "tf": tf, "list_at": list_at, "list_docs": list_docs,
        "block_at": np.concatenate(block_at), "block_docs": np.concatenate([np.zeros(0), *block_docs]),
        "block_owner": np.concatenate([np.zeros(0), *owner]), "summary": np.concatenate([np.zeros((0, blocked)), *summary]),
    }
    packed = {k: a.astype(KINDS[k]).tobytes() for k, a in arrays.items()}
    packed |= {"terms": names.cast(pa.string()), "doc_ids": ids.cast(pa.int64())}
    columns = []
    for f in INDEX_SCHEMA:
        x = packed[f.name]
        if isinstance(x, bytes):
            columns.append(pa.array([x], pa.binary()))
        else:
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x))
    return columns


def build(docs: DataFrame, corpus: tuple[int, int], coordinates: int = COORDINATES, block: int = BLOCK) -> DataFrame:
    """The index over all rows of ``docs``, a row for each segment of about ``SEGMENT_BYTES``.

    ``corpus`` is their ``corpus_size``; values in summaries hang on it. Segments are made where
    the rows lie, so a term of a third of all documents is spread over all segments and nothing is
    shuffled. Null and empty texts are documents without terms; a null id is kept, repeated rows are documents of
    their own, and a very long text is a segment of its own. Other columns are left out. An empty
    table gives an index without rows, in which nothing is found.
    """

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, SEGMENT_BYTES):
            yield pa.record_batch(segment(b["doc_id"], b["text"], corpus, coordinates, block), schema=INDEX_SCHEMA)

    return texts(docs).mapInArrow(make, INDEX)


class Segment:
    """A row of the index, with its forward lists cut down to the terms that are asked for."""

    def __init__(self, b: pa.RecordBatch, i: int, asked: pa.Array, corpus: tuple[int, int]):
        for name, kind in KINDS.items():
            setattr(self, name, np.frombuffer(b[name][i].as_buffer(), kind))
        ids = b["doc_ids"][i].values
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.doc_ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.blocks = len(self.block_at) - 1
        self.blocked = len(self.summary) // self.blocks if self.blocks else 0
        self.summary = self.summary.reshape(self.blocks, self.blocked)
        where = pc.index_in(b["terms"][i].values, asked)
        number = where.fill_null(-1).to_numpy(zero_copy_only=False)
        #: Of each asked term its number here, or -1.
        self.here = np.full(len(asked), -1, np.int64)
        self.here[number[number >= 0]] = np.flatnonzero(number >= 0)
        keep = (number >= 0)[self.term] if len(number) else np.zeros(0, bool)
        count = np.r_[0, np.cumsum(keep)]
        doc = np.repeat(np.arange(len(self.n)), np.diff(self.at))[keep]
        self.at, self.term = count[self.at], self.term[keep]
        self.value = value(self.tf[keep].astype(np.int64), self.n[doc], corpus)
        self.weights = np.zeros(max(len(number), 1), np.int64)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Exact scores of documents, from their forward lists and the weights that are set."""
        size = self.at[docs + 1] - self.at[docs]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[docs] - (ends - size), size)
        sums = np.r_[0, np.cumsum(self.weights[self.term[place]] * self.value[place])]
        return sums[ends] - sums[ends - size]


class Best:
    """The best ``k`` documents of each item so far, and the score that a further one must reach."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * items
        self.floor = np.ones(items, np.int64)

    def add(self, q: int, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        take = score >= self.floor[q]
        old = self.rows[q]
        score, null, ids = (np.r_[a, b[take]] for a, b in zip(old, (score, null, ids)))
        order = np.lexsort((ids, null, -score))[: self.k]
        self.rows[q] = score[order], null[order], ids[order]
        if len(order) == self.k:
            self.floor[q] = max(1, int(score[order[-1]]))


def search_segment(s: Segment, items: list[tuple[np.ndarray, np.ndarray]], best: Best) -> tuple[int, int]:
    """Add a segment's documents to ``best``; returns how many blocks were asked for and how many read.

    Documents with one of an item's rarer terms, those without blocks, are scored first. Any
    other document has frequent terms alone, so the product of weights and block summary is at
    least its score. Blocks with a bound below the floor are skipped: the best eight are read first
    to raise it. A document is scored once.
    """
    asked = read = 0
    new = np.ones(len(s.n), bool)
    for q, (terms, weight) in enumerate(items):
        present = s.here[terms] >= 0
        here, weights = s.here[terms][present], weight[present]
        if not len(here):
            continue
        s.weights[here] = weights
        new[:] = True

        def score(docs: np.ndarray) -> None:
            docs = docs[new[docs]]
            if len(docs):
                new[docs] = False
                docs = np.unique(docs)
                best.add(q, s.scores(docs), s.null[docs], s.doc_ids[docs])

        rare = here[here >= s.blocked]
        base = s.list_at[s.blocked]
        lists = [s.list_docs[s.list_at[t] - base : s.list_at[t + 1] - base] for t in rare.tolist()]
        if lists:
            score(np.concatenate(lists))
        if s.blocks:
            frequent = here[here < s.blocked]
            mine = np.zeros(s.blocked, bool)
            mine[frequent] = True
            blocks = np.flatnonzero(mine[s.block_owner])
            bound = (s.summary[np.ix_(blocks, frequent)] * s.weights[frequent]).sum(axis=1) * STEP
            asked += len(blocks)
            order = np.argsort(-bound, kind="stable")
            for some in (order[:8], order[8:]):
                some = blocks[some[bound[some] >= best.floor[q]]]
                read += len(some)
                if len(some):
                    score(np.concatenate([s.block_docs[s.block_at[i] : s.block_at[i + 1]] for i in some.tolist()]))
        s.weights[here] = 0
    return asked, read


def frequencies(index: DataFrame, asked: list[str]) -> np.ndarray:
    """Of each asked term the number of documents that hold it, a row of each task and term."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = pa.array(asked, pa.string()), np.zeros(len(asked), np.int64)
        for b in it:
            for i in range(len(b)):
                where = pc.index_in(b["terms"][i].values, known).fill_null(-1).to_numpy(zero_copy_only=False)
                found = where >= 0
                df[where[found]] += np.frombuffer(b["df"][i].as_buffer(), np.int32)[found]
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(some), pa.array(df[some])], ["term", "df"])

    df = np.zeros(len(asked), np.int64)
    for term, n in index.select("terms", "df").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    return df


#: Items that are asked at a time: so many bytes of text, so many items.
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 5_000


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """``(item_id, distinct terms)`` of items with a term, block by block."""
    block, size = [], 0
    for r in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        names = terms_of(pa.array([r["text"]], pa.string()))[0].unique().to_pylist()
        if names:
            if block and (size + len(r["text"]) > BLOCK_BYTES or len(block) == BLOCK_ITEMS):
                yield block
                block, size = [], 0
            block.append((r["item_id"], names))
            size += len(r["text"])
    if block:
        yield block


RESULT = "item_id long, rank int, doc_id long, score long"


def rank(spark: SparkSession, index: DataFrame, corpus: tuple[int, int], items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best documents of the index for each row of ``items``: the columns ``RESULT``.

    Scores are whole numbers; equal ones stand by ascending ``doc_id``, null ids last. Documents
    without a score above 0 are left out. Items are a stated query set: they go to the tasks that
    scan the index, in blocks of bounded size, each with one scan for the frequencies of its terms
    and one for the search. A task keeps ``k`` rows for each item; the rows of all tasks are
    cut to ``k`` in parts by document first, then by item, so that neither grows with the tasks.

    Null, empty and unspoken items have no rows. Repeated items are answered as often as they
    are there, items with a null id as well. An empty index or no items give no rows.
    """
    found = [_ranked(index, corpus, block, k) for block in item_blocks(items)]
    if not found:
        return spark.createDataFrame([], RESULT)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def _ranked(index: DataFrame, corpus: tuple[int, int], block: list[tuple[int, list[str]]], k: int) -> DataFrame:
    small_batches(index.sparkSession)
    asked = sorted({t for _, names in block for t in names})
    number = {t: i for i, t in enumerate(asked)}
    df = frequencies(index, asked)
    weight = np.array([math.floor(1000 * math.log((2 * corpus[0] + 2) / (2 * int(f) + 1))) if f else 0 for f in df], np.int64)
    queries = []
    for _, names in block:
        terms = np.array([number[t] for t in names])
        terms = terms[weight[terms] > 0]
        queries.append((terms, weight[terms]))

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best = pa.array(asked, pa.string()), Best(len(queries), k)
        for b in it:
            for i in range(len(b)):
                search_segment(Segment(b, i, known, corpus), queries, best)
        size = [len(r[0]) for r in best.rows]
        score, null, ids = (np.concatenate([r[j] for r in best.rows]) for j in range(3))
        q = np.repeat(np.arange(len(size)), size)
        yield pa.record_batch([pa.array(q), pa.array(ids, mask=null), pa.array(score)], ["q", "doc_id", "score"])

    rows = index.mapInArrow(search, "q long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for by in (["q", F.pmod(F.xxhash64("doc_id"), F.lit(64))], ["q"]):
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    names = index.sparkSession.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], "q long, item_id long")
    return rows.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def store(index: DataFrame, path: str) -> DataFrame:
    """Write an index and read it again: row groups hold a few segments, so that writers and readers do too.

    A row is megabytes, so sizes are looked at after each one, by default only after a hundred. Dictionaries, and the
    smallest and largest values of each row group, would be whole copies that a task keeps; values hardly repeat.
    """
    sizes = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
    copies = {"parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false"}
    index.write.options(**sizes, **copies, compression="zstd").parquet(path)
    return index.sparkSession.read.schema(INDEX).parquet(path)


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Index all rows of ``docs``, in the shared folder, and rank them for each item; see ``rank``."""
    corpus = corpus_size(docs)
    index = store(build(docs, corpus), shared_folder(docs.sparkSession, "postings"))
    return rank(docs.sparkSession, index, corpus, items, k)
