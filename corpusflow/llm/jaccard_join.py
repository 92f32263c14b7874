"""Documents whose sets of word n-grams are alike: a chosen-path join."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import batches, mixed, part, runs, texts, written
from corpusflow.llm.components import components, union_find

#: Paths that a set goes on along at each level, on average.
PATHS = 2.0
#: Levels at which buckets that are too large are split again.
LEVELS = 3
#: Members of a bucket that are compared with each other in one task. Larger buckets are split by
#: further n-grams; those still larger after ``LEVELS`` are compared block by block.
BUCKET = 1024
#: Members up to which a bucket is compared pair by pair, without a matrix.
FEW = 6
#: Member rows that one task takes at a time.
TASK_ROWS = 4000


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class Shingles:
    """Sets of hashed word n-grams; words are parted by ASCII white space, in lower case.

    A text of fewer than ``n`` words has one n-gram of all of them, one without words has none.
    """

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str) -> np.ndarray:
        if len(self.known) > 1_000_000:
            self.known.clear()
        words = word_hashes(text.lower().encode().split(), self.known)
        if not len(words):
            return words
        n = min(self.n, len(words))
        gram = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            gram = mixed(gram * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k], 7)
        return np.unique(gram)


def packed_shingles(n: int) -> Callable[[bytes], np.ndarray]:
    """``Shingles`` of compressed texts."""
    shingles, plain = Shingles(n), zstandard.ZstdDecompressor()
    return lambda data: shingles(plain.decompress(data).decode())


def all_of(cut: Callable[[bytes], np.ndarray]) -> Callable[[list[bytes]], list[np.ndarray]]:
    return lambda data: [cut(x) for x in data]


def chosen(grams: np.ndarray, path: int, level: int) -> np.ndarray:
    """Where a set goes on from ``path``: at n-grams that a hash of path and n-gram picks.

    Every set picks by the same hash, a set of ``s`` n-grams each with chance ``PATHS / s``, so two
    sets go on together along about ``PATHS`` times the share that they have in common.
    """
    seed = (path * 64 + level) % 2**64
    if len(grams) > PATHS:
        grams = grams[mixed(grams, seed) < np.uint64(int(PATHS / len(grams) * 2**64))]
    return mixed(grams, seed + 1).view(np.int64)


def repetitions(threshold: float, recall: float) -> int:
    """Runs until a pair at the threshold shares a bucket of the last level with chance ``recall``.

    The paths of a pair branch like a Poisson process of mean ``PATHS * threshold``.
    """
    lost = 0.0
    for _ in range(LEVELS):
        lost = math.exp(-PATHS * threshold * (1 - lost))
    return math.ceil(math.log(1 - recall) / math.log(lost))


def hashed(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def _keyed(docs: DataFrame, n: int, reps: int) -> DataFrame:
    """Each document's set as two hashes, its size and the paths of the first level; a hash of its text."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for b in batches(it):
            rows = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                grams = shingles(text)
                if len(grams):
                    whole = xxhash.xxh3_128_intdigest(grams.tobytes())
                    keys = np.unique(np.concatenate([chosen(grams, r + 1, 0) for r in range(reps)]))
                    rows.append((doc, (whole >> 64) - 2**63, whole % 2**64 - 2**63, len(grams), keys))
                else:
                    rows.append((doc, None, None, 0, []))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.record_batch([b["text_hash"], *columns], ["text_hash", "doc_id", "s1", "s2", "size", "keys"])

    return hashed(docs).mapInArrow(each, "text_hash long, doc_id long, s1 long, s2 long, size int, keys array<long>")


def _shared(rows: DataFrame) -> DataFrame:
    """``rows`` ``(rep, key)`` with ``n``, the members of the key, where there are at least two."""
    rows = written(rows.distinct(), "paths")
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def _split(hot: DataFrame, stored: DataFrame, n: int, level: int) -> DataFrame:
    """Members of hot buckets go on to the buckets of the next level."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = packed_shingles(n)
        for b in it:
            reps, keys = [], []
            for rep, data, paths in zip(*(b[k].to_pylist() for k in range(3))):
                grams = cut(data)
                for path in paths:
                    found = chosen(grams, path, level)
                    keys.append(found)
                    reps += [rep] * len(found)
            keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(reps, pa.int64()), pa.array(keys)], ["rep", "key"])

    paths = hot.groupBy("rep").agg(F.collect_list("key").alias("paths"))
    return stored.join(paths, "rep").select("rep", "data", "paths").mapInArrow(each, "rep long, key long")


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-6:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (len(a) + len(b) - both) - 1e-6


def alike(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets, as positions, whose Jaccard similarity reaches the threshold."""
    size = np.array([len(s) for s in sets])
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    common = count[gram] > 1
    gram, owner = (np.cumsum(count > 1) - 1)[gram[common]], owner[common]
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    same = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(gram[-1]) + 1 if len(gram) else 0, 2048):
        a, z = np.searchsorted(gram, [low, low + 2048])
        block = np.zeros((len(sets), 2048), np.float32)
        block[owner[a:z], gram[a:z] - low] = 1
        same += block @ block.T
    i, j = np.nonzero(np.triu(same, 1))
    both = same[i, j]
    ok = both >= threshold * (size[i] + size[j] - both) - 1e-6
    return i[ok], j[ok]


def once(buckets: DataFrame) -> DataFrame:
    """``buckets`` ``(rep, key, n)`` less those with the same members as one of a smaller key."""
    sums = buckets.groupBy("key", "n").agg(F.bit_xor(F.xxhash64("rep")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("b"))
    first = sums.groupBy("a", "b", "n").agg(F.min("key").alias("key"))
    return buckets.join(first.select("key"), "key", "left_semi").select("rep", "key", "n")


def linked(buckets: DataFrame, stored: DataFrame, make: Callable[[], Callable[[list[bytes]], list[np.ndarray]]], threshold: float) -> DataFrame:
    """``(rep, root, links)``: which members of buckets are alike.

    ``buckets``: ``(rep, key, n)`` with the members of each key; ``stored``: ``(rep, copies, data)``;
    ``make`` gives the function that cuts a list of ``data`` into sorted sets. A pair counts
    in the least of the buckets that both are in, so just once. Each bucket returns a forest: the
    least member that one is connected with there, and how many rows its links stand for. A bucket
    of more than ``BUCKET`` members is compared block by block, each pair of blocks apart.
    """
    buckets = written(once(buckets), "buckets")
    # A few tens of keys at most for each member.
    per_set = buckets.groupBy("rep").agg(F.collect_set(F.struct("key", "n")).alias("found"))
    named = stored.join(per_set, "rep").select("rep", "copies", "data", F.transform("found", lambda x: x["key"]).alias("final"), F.explode("found").alias("bucket"))
    blocks = F.ceil(F.col("bucket.n") / BUCKET).cast("int")
    named = named.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = named.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.col("bucket.key").alias("key"), "rep", "copies", "final", "data",
        (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).alias("block"),
        # Which of the two blocks a member is of; 2 if both are the same.
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("own"),
    )
    rows = buckets.agg(F.sum(F.ceil(F.col("n") / BUCKET))).first()[0] or 0
    tasks = max(1, -(-int(rows) // TASK_ROWS))
    members = placed.withColumn("task", part(F.struct("key", "block"), tasks))

    def each(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("block", "ascending"), ("rep", "ascending")])
        key, block, rep = (np.asarray(t[c]) for c in ("key", "block", "rep"))
        copies, own = np.asarray(t["copies"]), np.asarray(t["own"])
        final, data = t["final"].to_pylist(), t["data"]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def counted(at: int, length: int, pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
            """Pairs of a bucket that share no smaller bucket; of two blocks only those across them."""
            rows, bucket = slice(at, at + length), int(key[at])
            ids, across = rep[rows].tolist(), own[rows].tolist()
            less = [{x for x in f if x < bucket} for f in final[rows]]
            return [(a, b) for a, b in pairs if (across[a] == 2 or across[a] != across[b]) and ids[a] != ids[b] and less[a].isdisjoint(less[b])]

        groups = list(zip(*(x.tolist() for x in runs_of(key, block))))
        # Whether a pair of a small bucket counts here is known before its sets are cut.
        few = {at: counted(at, length, combinations(range(length), 2)) for at, length in groups if length <= FEW}
        needed = {int(rep[at + k]): at + k for at, pairs in few.items() for pair in pairs for k in pair}
        needed |= {int(rep[k]): k for at, length in groups if length > FEW for k in range(at, at + length)}
        sets = dict(zip(needed, make()(data.take(list(needed.values())).to_pylist())))

        for at, length in groups:
            ids = rep[at : at + length]
            own_sets = [sets.get(x) for x in ids.tolist()]
            if length <= FEW:
                pairs = [(a, b) for a, b in few[at] if similar(own_sets[a], own_sets[b], threshold)]
            else:
                i, j = alike(own_sets, threshold)
                pairs = counted(at, length, zip(i.tolist(), j.tolist()))
            if pairs:
                i, j = np.array(pairs, np.int64).T
                rows = copies[at : at + length]
                links = np.bincount(i, rows[j], length) + np.bincount(j, rows[i], length)
                nodes, roots = union_find(ids[i], ids[j])
                out.append((nodes, roots, links[np.searchsorted(ids, nodes)].astype(np.int64)))
        whole = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("rep", "root", "links"), whole)))

    return members.groupBy("task").applyInArrow(each, "rep long, root long, links long")


def runs_of(key: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal ``(key, block)`` in sorted rows."""
    if not len(key):
        return runs(key)
    new = np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])]
    return runs(np.cumsum(new))


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99) -> DataFrame:
    """``(doc_id, class_id, n_links)`` of each row of ``docs``.

    Two documents are linked if the Jaccard similarity of their sets of word ``n``-grams is at
    least ``threshold``; ``n_links`` counts the other rows that a row is linked with, equal sets
    included, and ``class_id`` is the least ``doc_id`` of all that links connect. Equal sets are
    one from the start; buckets with equal n-grams on their path are compared pair by pair, and
    runs repeat until a pair at the threshold is met with chance ``recall``. Rows without words
    or without an id have no links; without words the class is their own id.
    """
    reps = repetitions(threshold, recall)
    keyed = written(_keyed(docs, n, reps), "sets")
    with_set = keyed.where("doc_id IS NOT NULL AND size > 0")
    # A set goes by the first half of its hash; rows may share an id and differ in their texts.
    one = with_set.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.count("*").alias("copies"), F.first("keys").alias("keys"))
    distinct = written(one.select(F.col("s1").alias("rep"), "s2", "one.*", "copies", "keys"), "distinct-sets")
    # The first level. What shares no path with another set is done.
    level = written(_shared(distinct.select("rep", F.explode("keys").alias("key"))), "buckets")
    wanted = distinct.join(level.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "text_hash", "copies")
    stored = written(_stored(docs, wanted), "members")
    final, hot = [level.where(F.col("n") <= BUCKET)], level.where(F.col("n") > BUCKET)
    for k in range(1, LEVELS):
        if hot.isEmpty():
            break
        level = written(_shared(_split(hot, stored, n, k)), "buckets")
        final.append(level.where(F.col("n") <= BUCKET))
        hot = level.where(F.col("n") > BUCKET)
    final.append(hot)
    buckets = final[0]
    for more in final[1:]:
        buckets = buckets.unionByName(more)
    found = written(linked(buckets, stored, lambda: all_of(packed_shingles(n)), threshold), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    ids = distinct.select("rep", "doc_id")
    members = components(found.select("rep", "root")).withColumnRenamed("node", "rep")
    least = members.join(ids, "rep").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    classes = members.join(least, "root").select("rep", "class_id")
    of_set = distinct.select("rep", "s2", "doc_id", "copies").join(links, "rep", "left").join(classes, "rep", "left")
    of_set = of_set.select(
        F.col("rep").alias("s1"), "s2", F.coalesce("class_id", "doc_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    rows = keyed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("s1")).alias("s1"), "s2").join(of_set, ["s1", "s2"], "left")
    return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _stored(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts, compressed before they are shuffled, of the documents that stand for the sets in ``wanted``.

    Rows may share an id; the hash of the text says which of them has the set.
    """

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for b in batches(it):
            data = pa.array((small.compress(t.encode()) for t in b["text"].to_pylist()), pa.binary())
            yield pa.record_batch([b["doc_id"], b["text_hash"], data], ["doc_id", "text_hash", "data"])

    found = hashed(docs).where("doc_id IS NOT NULL").mapInArrow(each, "doc_id long, text_hash long, data binary")
    return found.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("rep", "copies", "data")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` less the rows whose class has a smaller ``doc_id``; see ``join``.

    All columns stay. Rows that share an id share their fate; rows without an id stay.
    """
    others = join(docs, **options).where("class_id != doc_id").select(F.col("doc_id").alias("other_id")).distinct()
    return docs.join(others, docs["doc_id"] == others["other_id"], "left_anti")
