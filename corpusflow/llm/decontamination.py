"""Passages of test items in documents: rare n-gram seeds, then local alignment."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import batches, part, texts

#: Words of a seed, and seeds in a row of which the rarest that occurs stands for all.
GRAM, WINDOW = 3, 2
#: Occurrences up to which an n-gram is a seed beside a rarer one too: its hits cost next to nothing.
RARE = 100
#: Bytes of items that are searched at a time; a larger benchmark takes more scans.
BLOCK_BYTES = 8_000_000
#: Seeds that must lie near one diagonal before an alignment is tried.
LEAST_SEEDS = 2
MATCH, MISMATCH, GAP = 2, -1, -1

#: Signs of ASCII part words like white space does.
APART = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words in lower case, without ASCII signs."""
    return text.lower().encode().translate(APART).split()


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: best local score of ``a`` in ``b``, and where it begins and ends in ``b``.

    One row for each word of ``a``; gaps along a row are a running maximum.
    """
    steps = np.arange(len(b) + 1)
    last = np.zeros(len(b) + 1, np.int64)
    origin = steps.copy()  # where the alignment that ends here began
    best = (0, 0, 0)
    for x in a:
        diagonal = last[:-1] + np.where(b == x, MATCH, MISMATCH)
        above = last[1:] + GAP
        here = np.r_[0, np.maximum(np.maximum(diagonal, above), 0)]
        begin = np.r_[0, np.where(diagonal >= above, origin[:-1], origin[1:])]
        begin = np.where(here == 0, steps, begin)
        # From the left: the best cell so far, less a gap for each step since.
        lifted = here - GAP * steps
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == run, steps, 0))
        now = run + GAP * steps
        begin = np.where(now > here, begin[source], begin)
        top = int(now.argmax())
        if now[top] > best[0]:
            best = (int(now[top]), int(begin[top]), top)
        last, origin = now, begin
    return best


class Items:
    """Test items as numbered words, with the n-grams that may seed a match."""

    def __init__(self, rows: Sequence[tuple[int, str]]):
        self.words: dict[bytes, int] = {}
        self.ids: list[list[int]] = []
        self.codes, first = [], {}
        for item, text in sorted(rows):
            words = words_of(text)
            key = tuple(words)
            if key in first and item not in self.ids[first[key]]:
                self.ids[first[key]].append(item)  # equal items are searched as one
            if len(words) < GRAM or key in first:
                continue
            first[key] = len(self.ids)
            self.ids.append([item])
            self.codes.append(np.array([self.words.setdefault(w, len(self.words)) for w in words], np.int64))
        self.base = len(self.words) + 1
        self.own = [self.grams(c) for c in self.codes]
        self.all = np.unique(np.concatenate(self.own)) if self.own else np.zeros(0, np.int64)

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """Each run of ``GRAM`` words as a number, -1 if one is in no item."""
        n = max(0, len(codes) - GRAM + 1)
        key, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(GRAM):
            key = key * self.base + codes[k : k + n]
            known &= codes[k : k + n] >= 0
        return np.where(known, key, -1)

    def number(self, text: str) -> np.ndarray:
        words = words_of(text)
        get = self.words.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def hits(self, codes: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a document of the n-grams ``among`` (ascending), and which they are."""
        grams = self.grams(codes)
        at = np.flatnonzero(grams >= 0)
        if not len(at) or not len(among):
            return at[:0], at[:0]
        found = np.minimum(np.searchsorted(among, grams[at]), len(among) - 1)
        hit = among[found] == grams[at]
        return at[hit], found[hit]

    def choose(self, count: np.ndarray) -> None:
        """Seeds: of each ``WINDOW`` n-grams in a row of an item the rarest in the corpus, and rare ones.

        N-grams that occur nowhere can't hit and take no other's place. An edited copy may lack the
        rarest of a window where another document has it, so all ``RARE`` ones stand for themselves.
        """
        seeds: dict[int, list[tuple[int, int]]] = {}
        self.chosen = []
        for k, grams in enumerate(self.own):
            often = count[np.searchsorted(self.all, grams)]
            width = min(WINDOW, len(grams))
            windows = np.lib.stride_tricks.sliding_window_view(np.where(often, often, np.iinfo(often.dtype).max), width)
            rarest = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
            places = np.union1d(rarest[often[rarest] > 0], np.flatnonzero((often > 0) & (often <= RARE)))
            self.chosen.append(len(places))
            for at in places:
                seeds.setdefault(int(grams[at]), []).append((k, int(at)))
        self.seeds = np.array(sorted(seeds), np.int64)
        self.places = [seeds[g] for g in self.seeds.tolist()]

    def matches(self, text: str, least: float) -> list[tuple[int, float, int, int]]:
        """``(item, score, begin, end)`` of the items found in a text, in words of the text."""
        codes = self.number(text)
        at, which = self.hits(codes, self.seeds)
        diagonals: dict[int, list[int]] = {}
        for p, s in zip(at.tolist(), which.tolist()):
            for k, q in self.places[s]:
                diagonals.setdefault(k, []).append(p - q)
        found = []
        for k, offsets in diagonals.items():
            if len(offsets) < min(LEAST_SEEDS, self.chosen[k]):
                continue
            codes_of, margin = self.codes[k], len(self.codes[k]) // 4 + 4
            offsets = np.sort(offsets)
            best = (0, 0, 0)
            for group in np.split(offsets, np.flatnonzero(np.diff(offsets) > margin) + 1):
                if len(group) < min(LEAST_SEEDS, self.chosen[k]):
                    continue
                low, high = max(0, int(group[0]) - margin), int(group[-1]) + len(codes_of) + margin
                score, begin, end = align(codes_of, codes[low:high])
                best = max(best, (score, low + begin, low + end))
            share = best[0] / (MATCH * len(codes_of))
            if share >= least:
                found += [(item, share, best[1], best[2]) for item in self.ids[k]]
        return found


def _counted(docs: DataFrame, items: Items) -> np.ndarray:
    """How often each n-gram of the items occurs in all documents."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.all), np.int64)
        for b in batches(it):
            codes = [x for t in b[0].to_pylist() for x in (items.number(t), [-1])]
            _, which = items.hits(np.concatenate(codes).astype(np.int64), items.all)
            total += np.bincount(which, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["gram", "n"])

    counted = texts(docs).select("text").mapInArrow(each, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    count = np.zeros(len(items.all), np.int64)
    for gram, n in counted.collect():  # n-grams of one block of items at most
        count[gram] = n
    return count


def search(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaked, item_ids, scores, item_id, score, begin, end``.

    ``item_ids`` are all items whose best alignment reaches ``least``, as a share of the score of
    the whole item, ascending, with their ``scores``; ``item_id`` and the rest say which is best and the
    words of the text, from 0, that it covers. Items with equal words are all found, each id once;
    of items with equal scores the least id is the best. Items of fewer than ``GRAM`` words or without
    an id are not searched. Null and empty texts match none, repeated rows match alike, and very
    long texts are searched whole. Other columns are left out. Without documents there are no rows.

    Items are few beside documents: blocks of them, of bounded size, go to all tasks, and documents are
    scanned twice for each block, once to count its n-grams and once to match; nothing of the
    documents is shuffled. What many documents share stays searchable: a seed is rare in
    comparison with its neighbours in the item.
    """
    known = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("item_text")).where("item_id IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("item_text") + 64)).first()[0] or 0
    parts = max(1, -(-size // BLOCK_BYTES))
    found = texts(docs).select("doc_id", "text", F.array().cast("array<struct<item_id:bigint,score:double,begin:int,end:int>>").alias("found"))
    for k in range(parts):
        block = known.where(part(F.col("item_text"), parts) == k).collect()
        items = Items([(r["item_id"], r["item_text"]) for r in block])
        if items.ids:
            items.choose(_counted(docs, items))
            found = _matched(found, items, least)
    best = F.array_max(F.transform("found", lambda x: F.struct(x["score"].alias("score"), (-x["item_id"]).alias("item"), x["begin"].alias("begin"), x["end"].alias("end"))))
    order = F.array_sort("found")
    return found.select("doc_id", order.alias("found"), best.alias("best")).select(
        "doc_id", (F.size("found") > 0).alias("leaked"),
        F.transform("found", lambda x: x["item_id"]).alias("item_ids"), F.transform("found", lambda x: F.round(x["score"], 6)).alias("scores"),
        (-F.col("best.item")).alias("item_id"), F.round("best.score", 6).alias("score"), "best.begin", "best.end",
    )


def _matched(rows: DataFrame, items: Items, least: float) -> DataFrame:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("begin", pa.int32()), ("end", pa.int32())]))
    names = ("item_id", "score", "begin", "end")

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            more = [
                before + [dict(zip(names, m)) for m in items.matches(t, least)]
                for t, before in zip(b[1].to_pylist(), b[2].to_pylist())
            ]
            yield pa.record_batch([b[0], b[1], pa.array(more, kind)], ["doc_id", "text", "found"])

    return rows.mapInArrow(each, rows.schema)


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    leaked = search(docs, benchmark, least).where("leaked").select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["leaked_id"]), "left_anti")
