"""Lines that are alike across the corpus: MinHash bands, exact check, one line per component."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import batches, mixed, runs, texts, written
from corpusflow.llm.components import components
from corpusflow.llm.jaccard_join import linked


class Kind(NamedTuple):
    """Lines of ``least`` to ``most`` characters, compared by shingles of ``width`` characters.

    Two of them whose sets have a similarity of 0.8 share one of ``bands`` bands of ``rows``
    signature numbers with a chance of over 99 %.
    """

    width: int
    least: int
    most: int
    bands: int
    rows: int


#: One changed character breaks ``width`` shingles, which only lines of 39 characters survive at a
#: width of 4 and of 79 at a width of 8. Short shingles meet by chance, so their bands are longer. Two
#: lines meet in each kind that both belong to: lengths between 128 and 160 are in both, since
#: alike lines differ in length by a fifth at most.
KINDS = (Kind(4, 4, 159, 21, 7), Kind(8, 128, 2**31, 10, 4))
BASE = 0x9E3779B97F4A7C15
#: Characters that are hashed at a time, few enough to stay in a processor's cache.
BLOCK_CHARS = 50_000
#: Lines whose bands are mixed at a time; they hold a few megabytes.
BLOCK_LINES = 4096
#: Lines for each part that the bands are dealt to, with 31 bands a line at most.
PART_LINES = 50_000
#: Bands that a task takes in at a time, and those it may hold that wait for a second line.
BLOCK_BANDS, HELD_BANDS = 1_000_000, 8_000_000


def normal(line: str) -> str:
    """A line in lower case with single spaces."""
    return _spaced(line.lower())


def _spaced(line: str) -> str:
    """``line`` with single spaces; most lines have them already, which is told without cutting words."""
    # All white space but the space itself counts as not printable.
    if line.isprintable() and "  " not in line and line[:1] != " " and line[-1:] != " ":
        return line
    return " ".join(line.split())


def key_of(line: str) -> int:
    """Hash of a line, even: its last bit is left for a kind."""
    return (xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - 2**63) & -2


def shingle_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` characters from each position on, by doubling; ``width`` is a power of two."""
    h, done, base = codes.astype(np.uint64) + np.uint64(1), 1, BASE
    while done < width:
        h = h[:-done] * np.uint64(base) + h[done:]
        done, base = 2 * done, base * base % 2**64
    return mixed(h, 3)


def shingle_set(line: str, width: int) -> np.ndarray:
    return shingle_sets([line], width)[0]


def shingle_sets(lines: list[str], width: int) -> list[np.ndarray]:
    """The sorted set of each line's shingles."""
    found = []
    for first, last in blocks(lines):
        hashes, starts = line_hashes(lines[first:last], width)
        for h in np.split(hashes, starts[1:]):
            h.sort()
            found.append(h[np.r_[True, h[1:] != h[:-1]]])
    return found


def named_sets(data: list[bytes]) -> list[np.ndarray]:
    """The sets of stored lines, each the number of its kind, then its text."""
    found: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(data)
    for number, kind in enumerate(KINDS):
        own = [k for k, x in enumerate(data) if x[0] == number]
        sets = shingle_sets([data[k][1:].decode("utf-8", "surrogatepass") for k in own], kind.width)
        for k, x in zip(own, sets):
            found[k] = x
    return found


def blocks(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of lines of about ``BLOCK_CHARS`` characters, from the first to before the last."""
    first = 0
    while first < len(lines):
        last, chars = first, 0
        while last < len(lines) and chars < BLOCK_CHARS:
            chars += len(lines[last])
            last += 1
        yield first, last
        first = last


def band_keys(lines: list[str], number: int) -> np.ndarray:
    """A row of hashes, one a band, for each of some lines of a kind; their last bit is its number."""
    kind = KINDS[number]
    rng = np.random.default_rng(11)
    odd = rng.integers(0, 2**31, (kind.bands, kind.rows), dtype=np.uint64).astype(np.uint32) * 2 + 1
    found = np.empty((len(lines), kind.bands), np.int64)
    for low in range(0, len(lines), BLOCK_LINES):
        some = lines[low : low + BLOCK_LINES]
        least = np.empty((kind.rows, kind.bands, len(some)), np.uint32)
        for first, last in blocks(some):
            hashes, starts = line_hashes(some[first:last], kind.width)
            x = (hashes >> np.uint64(32)).astype(np.uint32)
            product = np.empty_like(x)
            for b in range(kind.bands):
                for k in range(kind.rows):
                    np.multiply(x, odd[b, k], out=product)
                    np.minimum.reduceat(product, starts, out=least[k, b, first:last])
        key = np.arange(1, kind.bands + 1, dtype=np.uint64)[:, None]
        for k in range(kind.rows):
            key = mixed(key * np.uint64(BASE) + least[k], 1)
        found[low : low + len(some)] = (key.view(np.int64) & -2 | number).T
    return found


def line_hashes(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all lines, and where each line's begin; no line is shorter than ``width``."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    # Shingles that run over the end of a line are left out.
    whole = np.ones(len(codes), bool)
    ends = np.cumsum(length)
    for k in range(1, width):
        whole[ends - k] = False
    hashes = shingle_hashes(codes, width)
    count = length - width + 1
    return hashes[whole[: len(hashes)]], np.cumsum(count) - count


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def _lines(text: str) -> list[tuple[int, str]]:
    """Number and normal form of the lines that are not blank."""
    found = ((k, _spaced(x)) for k, x in enumerate(text.lower().split("\n")))
    return [(k, x) for k, x in found if x]


def places(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, n_lines, line_no, key, bands, data)`` of each line that is not blank.

    The first row of a document has its ``n_lines``; without such a line it has one row, without
    ``key``. Of equal lines of a batch only the first has ``bands``, of all kinds that it belongs to,
    as the bytes of 64-bit numbers, and its normal form as ``data``.
    """

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            plain = b[2].to_pylist()
            found = [_lines(t) or [(None, "")] for t in plain]
            rows = [len(x) for x in found]
            at = pa.array(np.repeat(np.arange(len(found)), rows))
            flat = [x for lines in found for x in lines]
            later = np.ones(len(flat), bool)
            later[np.cumsum([0, *rows[:-1]])] = False
            n_lines = np.repeat(np.fromiter((t.count("\n") + 1 for t in plain), np.int64, len(plain)), rows)
            keys = np.array([key_of(x) for _, x in flat], np.int64)
            length = np.fromiter((len(x) for _, x in flat), np.int64, len(flat))
            _, first = np.unique(keys, return_index=True)
            bands: list[bytes | None] = [None] * len(flat)
            for number, kind in enumerate(KINDS):
                own = first[(length[first] >= kind.least) & (length[first] <= kind.most)]
                for i, found_bands in zip(own.tolist(), band_keys([flat[i][1] for i in own], number)):
                    bands[i] = (bands[i] or b"") + found_bands.tobytes()
            data = (None if n is None else x.encode("utf-8", "surrogatepass") for (_, x), n in zip(flat, bands))
            columns = {
                "doc_id": b[0].take(at),
                "text_hash": b[1].take(at),
                "n_lines": pa.array(n_lines, mask=later),
                "line_no": pa.array([k for k, _ in flat], pa.int32()),
                "key": pa.array(keys, mask=length == 0),
                "bands": pa.array(bands, pa.binary()),
                "data": pa.array(data, pa.binary()),
            }
            yield pa.record_batch(list(columns.values()), list(columns))

    return _keyed(docs).mapInArrow(each, "doc_id long, text_hash long, n_lines long, line_no int, key long, bands binary, data binary")


def _dealt(lines: DataFrame, parts: int) -> DataFrame:
    """``(part, keys, reps)``: the bands of lines ``(key, bands)`` of a batch that go to the same part.

    ``keys`` are bands and ``reps`` their lines, as the bytes of 64-bit numbers, so that a shuffle
    moves few rows. A line is compared apart in each of its kinds.
    """

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            data = b["bands"].to_pylist()
            band = np.frombuffer(b"".join(data), np.int64)
            rep = np.repeat(np.asarray(b["key"]), [len(x) // 8 for x in data]) | band & 1
            to = ((band.view(np.uint64) >> np.uint64(1)) % np.uint64(parts)).astype(np.uint16 if parts < 2**16 else np.uint32)
            order = np.argsort(to, kind="stable")
            to, band, rep = to[order], band[order], rep[order]
            at, length = runs(to)
            columns = [pa.array([x[i : i + n].tobytes() for i, n in zip(at, length)], pa.binary()) for x in (band, rep)]
            yield pa.record_batch([pa.array(to[at].astype(np.int32)), *columns], ["part", "keys", "reps"])

    return lines.mapInArrow(each, "part int, keys binary, reps binary")


def _shared(dealt: DataFrame, parts: int) -> DataFrame:
    """``(key, rep)`` of bands that two different lines share; most bands have one line only.

    A task holds one line of each of its bands, and passes on all of a band as soon as it sees a
    second line, so a band may have any number of lines. Rows may repeat. A task with more bands
    than it may hold passes on all from there: bands of one line are then among the rows.
    """

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        held = nothing  # key, line and whether it was passed on, sorted by key
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        full = False

        def seen() -> pa.RecordBatch:
            nonlocal held, full
            key, rep = (np.concatenate([held[k], *(w[k] for w in waiting)]) for k in (0, 1))
            passed = np.r_[held[2], np.zeros(len(key) - len(held[2]), bool)]
            order = np.argsort(key, kind="stable")  # the line that is held comes first
            key, rep, passed = key[order], rep[order], passed[order]
            at, length = runs(key)
            lead = rep[at]
            many = passed[at]
            if len(at):
                many |= np.logical_or.reduceat(rep != np.repeat(lead, length), at)
            held = key[at], lead, many
            out = np.repeat(many, length)
            full = full or len(at) > HELD_BANDS
            if full:
                out, held = np.ones(len(key), bool), nothing
            out &= ~passed
            return pa.record_batch([pa.array(key[out]), pa.array(rep[out])], ["key", "rep"])

        n = 0
        for b in it:
            for keys, reps in zip(b["keys"].to_pylist(), b["reps"].to_pylist()):
                waiting.append((np.frombuffer(keys, np.int64), np.frombuffer(reps, np.int64)))
                n += len(keys) // 8
                if n >= BLOCK_BANDS:
                    yield seen()
                    waiting, n = [], 0
        yield seen()

    return dealt.repartitionById(parts, "part").select("keys", "reps").mapInArrow(each, "key long, rep long")


def _line_key(rep: str) -> Column:
    """The hash of a line, whatever the kind it is compared in."""
    return F.col(rep).bitwiseAND(F.lit(-2).cast("long"))


def _stored(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(rep, copies, data)``: of the lines ``(key, data)`` those in ``wanted``, with the number of their kind in front."""
    kinds = wanted.groupBy(_line_key("rep").alias("key")).agg(F.collect_set("rep").alias("reps"))  # two at most
    some = lines.join(kinds.hint("shuffle_hash"), "key")
    some = some.groupBy("key").agg(F.first("data").alias("data"), F.first("reps").alias("reps")).select("data", F.explode("reps").alias("rep"))
    number = F.when(F.col("rep").bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    return some.select("rep", F.lit(1).cast("long").alias("copies"), F.concat(number, "data").alias("data"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def repeated_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(doc_id, text_hash, n_lines, removed)`` of each row of ``docs``.

    ``removed`` are the numbers, from 0, of the ``\\n``-split lines that give way to another. Lines,
    in lower case with single spaces, are alike if they are equal, if both have 4 to 159 characters
    and their sets of 4-character shingles a Jaccard similarity of at least ``threshold``, or if both
    have at least 128 and their sets of 8-character shingles do; of the lines that this connects the
    first by ``doc_id``, hash of the text and line number stays. Blank lines stay; null texts have
    one empty line. Equal 63-bit hashes count as equal lines. Rows that are wholly equal are judged
    as one row, so all of them keep the same lines. Other columns are not looked at.
    """
    all_places = written(places(docs), "places", compression="zstd")
    parts = 1 + all_places.count() // PART_LINES
    bands = _dealt(all_places.where("bands IS NOT NULL").select("key", "bands"), parts)
    shared = written(_shared(bands, parts).distinct(), "bands")
    members = shared.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = written(shared.join(members, "key").select("rep", "key", "n"), "buckets")
    stored = written(_stored(all_places.where("data IS NOT NULL").select("key", "data"), buckets.select("rep").distinct()), "lines")
    found = linked(buckets, stored, lambda: named_sets, threshold)
    classes = components(found.select(_line_key("rep").alias("rep"), _line_key("root").alias("root"))).select(F.col("node").alias("key"), "root")
    place = F.struct("doc_id", "text_hash", "line_no")
    base = all_places.where("n_lines IS NOT NULL").select("doc_id", "text_hash", "n_lines")
    all_places = all_places.where("key IS NOT NULL").select("doc_id", "text_hash", "line_no", "key")
    per_key = all_places.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # A line that is there once and like no other stays.
    of_class = per_key.join(classes.hint("shuffle_hash"), "key", "left").where("n > 1 OR root IS NOT NULL")
    of_class = written(of_class.withColumn("root", F.coalesce("root", "key")), "line-classes")
    kept = of_class.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("n")).where("n > 1")
    doubtful = of_class.select("key", "root").join(kept, "root").select("key", "kept")
    gone = all_places.join(doubtful.hint("shuffle_hash"), "key").where(
        ~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash")) & (F.col("line_no") == F.col("kept.line_no")))
    )
    # At most the lines of one document.
    removed = gone.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    of_row = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    return base.join(removed, of_row, "left").select("doc_id", "text_hash", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with the lines that stay; documents that lose all lines with a word are left out.

    Columns stay as they are but for ``text`` and, if there is one, ``n_chars``. Documents that
    had no such line before stay.
    """
    removed = repeated_lines(docs, threshold).where(F.size("removed") > 0).select("doc_id", "text_hash", "removed").dropDuplicates(["doc_id", "text_hash"])
    names = docs.columns
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    rows = keyed.join(removed, _same(keyed, removed), "left").select("row", "removed")
    lines = F.split(F.col("row.text"), "\n")
    rest = F.array_join(F.filter(lines, lambda x, k: ~F.array_contains("removed", k)), "\n")
    rows = rows.select("row", F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(rest).alias("new_text"), F.col("removed").isNotNull().alias("cut"))
    rows = rows.where(~F.col("cut") | F.regexp_like("new_text", F.lit(r"[^\x20\x09-\x0D]")))
    changed = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return rows.select(*(changed.get(n, F.col(f"row.`{n}`")).alias(n) for n in names))
