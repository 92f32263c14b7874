"""Packing of text segments into token-budgeted chunks with overlap.

A chunk always covers a contiguous run of the words of its section: perhaps some words
carried over from the chunk before, then whole segments. The fold over the segments thus
only moves integer positions; texts are cut out of the word and segment arrays at the end.
A prepared section is a struct of ``text``, ``n_words``, ``words``, ``segments`` and
``segment_words`` (words per segment), plus whatever the token counter measured. Words and
segments are left empty if the text surely fits into one chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.sections import split_paragraphs, split_sentences
from corpusflow.functions.text import join_slice, let, materialize, words
from corpusflow.functions.tokens import FunctionCounter, WordCounter
from corpusflow.session import small_batches

# The defaults of the chunking job.
CHUNK_SIZE = 512
CHUNK_OVERLAP = 100
MIN_CHUNK_CHARS = 50


@dataclass(frozen=True)
class Packing:
    """Token budget of a chunk, tokens shared with the chunk before, the counter and the cut.

    ``split`` cuts a section over the budget into stripped segments, which are then packed; without
    it they are paragraphs or sentences.
    """

    chunk_size: int = CHUNK_SIZE
    overlap: int = CHUNK_OVERLAP
    min_chars: int = MIN_CHUNK_CHARS
    counter: WordCounter | FunctionCounter = field(default_factory=WordCounter)
    split: Callable[[Column], Column] | None = None


NO_RANGES = (
    "array<struct<from_word:int,to_word:int,from_segment:int,to_segment:int,"
    "end_word:int,forced:boolean>>"
)
NO_SPANS = "array<struct<from_word:int,to_word:int>>"


def _range(from_word, to_word, from_segment, to_segment, end_word, forced: bool) -> Column:
    return F.struct(
        from_word.alias("from_word"),
        to_word.alias("to_word"),
        from_segment.alias("from_segment"),
        to_segment.alias("to_segment"),
        end_word.alias("end_word"),
        F.lit(forced).alias("forced"),
    )


def _state(out, from_word, to_word, from_segment, at, tokens) -> Column:
    return F.struct(
        out.alias("out"),
        from_word.alias("from_word"),
        to_word.alias("to_word"),
        from_segment.alias("from_segment"),
        at.alias("at"),
        tokens.alias("tokens"),
    )


def _indices(start: Column, end: Column) -> Column:
    """The integers ``start..end-1``; none if the range is empty."""
    return F.when(end > start, F.sequence(start, end - 1)).otherwise(
        F.array().cast("array<int>")
    )


# Elements that are folded before their results join the list of all results.
BLOCK = 128


def _fold(
    start: Column,
    end: Column,
    none: Column,
    fields: dict[str, Column],
    step: Callable[[Column, Column], Column],
    finish: Callable[[Column], Column],
) -> Column:
    """Fold over the integers ``start..end-1`` with a state of results ``out`` and ``fields``.

    Spark copies the state at every element. Folding in blocks, which begin without
    results, keeps those copies small however many results there are in the end.
    """

    def state(out: Column, values: Callable[[str], Column]) -> Column:
        return F.struct(out.alias("out"), *[values(name).alias(name) for name in fields])

    def fold_block(st: Column, first: Column) -> Column:
        block = F.aggregate(
            _indices(first, F.least(first + BLOCK, end)), state(none, lambda f: st[f]), step
        )
        return let(block, lambda b: state(F.concat(st["out"], b["out"]), lambda f: b[f]))

    blocks = F.when(end > start, F.sequence(start, end - 1, F.lit(BLOCK))).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(blocks, state(none, lambda f: fields[f]), fold_block, finish)


def pack_ranges(s: Column, p: Packing) -> Column:
    """Where the chunks of a prepared section begin and end.

    Each range is carried words ``from_word..to_word`` followed by the whole segments
    ``from_segment..to_segment``, up to ``end_word``; a ``forced`` range is one segment over the budget, given
    by its words, which ``word_spans`` has to cut further.
    """
    counter, zero = p.counter, F.lit(0)

    def step(st: Column, i: Column) -> Column:
        at, pw, pe, s0 = st["at"], st["from_word"], st["to_word"], st["from_segment"]
        n = F.get(s["segment_words"], i)
        tokens = counter.segment_tokens(s, i)
        has_content = (s0 < i) | (pw < pe)
        chunk = _range(pw, pe, s0, i, at, False)
        forced = _range(at, at + n, i, i, at + n, True)

        carried = counter.joined_words(s, pw, pe)
        held = carried + F.when(pw < pe, counter.more_segments(s, s0, i, at - pe)).otherwise(
            counter.joined_segments(s, s0, i, at - pe)
        )
        tail = counter.tail_start(s, pw, at, p.overlap)
        appended = F.concat(st["out"], F.array(chunk))

        split_segment = _state(
            F.when(has_content, F.concat(st["out"], F.array(chunk, forced))).otherwise(
                F.concat(st["out"], F.array(forced))
            ),
            at + n, at + n, i + 1, at + n, zero,
        )
        keep_all = _state(
            appended, pw, pe, s0, at + n, held + counter.more_segments(s, i, i + 1, n)
        )
        keep_tail = let(
            tail,
            lambda t: _state(
                appended, t, at, i, at + n,
                counter.joined_words(s, t, at)
                + F.when(t < at, counter.more_segments(s, i, i + 1, n)).otherwise(
                    counter.joined_segments(s, i, i + 1, n)
                ),
            ),
        )
        grow = _state(st["out"], pw, pe, s0, at + n, st["tokens"] + tokens)
        return (
            F.when(tokens > p.chunk_size, split_segment)
            .when(~has_content | (st["tokens"] + tokens <= p.chunk_size), grow)
            .when(held <= p.overlap, keep_all)
            .otherwise(keep_tail)
        )

    def finish(st: Column) -> Column:
        n = F.size(s["segments"])
        last = _range(
            st["from_word"], st["to_word"], st["from_segment"], n, st["at"], False
        )
        has_content = (st["from_segment"] < n) | (st["from_word"] < st["to_word"])
        return F.when(has_content, F.concat(st["out"], F.array(last))).otherwise(st["out"])

    fields = {f: zero for f in ("from_word", "to_word", "from_segment", "at", "tokens")}
    none = F.array().cast(NO_RANGES)
    return _fold(zero, F.size(s["segments"]), none, fields, step, finish)


def word_spans(s: Column, start: Column, end: Column, p: Packing) -> Column:
    """Cut words ``start..end-1`` of a prepared section into spans within the budget.

    The overlap of such spans counts words, not tokens. A span that has no more words than
    the overlap is carried over whole.
    """
    counter = p.counter

    def step(st: Column, j: Column) -> Column:
        tokens = st["tokens"] + counter.words_alone(s, j, j + 1)
        first = st["first"]
        carried = (
            F.when(j - first > p.overlap, j - p.overlap).otherwise(first)
            if p.overlap > 0
            else j
        )
        span = F.struct(first.alias("from_word"), j.alias("to_word"))
        grow = F.struct(st["out"].alias("out"), first.alias("first"), tokens.alias("tokens"))
        restart = F.struct(
            F.concat(st["out"], F.array(span)).alias("out"),
            carried.alias("first"),
            counter.joined_words(s, carried, j + 1).alias("tokens"),
        )
        return F.when((tokens > p.chunk_size) & (j > first), restart).otherwise(grow)

    def finish(st: Column) -> Column:
        last = F.struct(st["first"].alias("from_word"), end.alias("to_word"))
        return F.when(end > start, F.concat(st["out"], F.array(last))).otherwise(st["out"])

    fields = {"first": start, "tokens": F.lit(0)}
    return _fold(start, end, F.array().cast(NO_SPANS), fields, step, finish)


def _chunk(text: Column, tokens: Column) -> Column:
    return F.struct(text.alias("text"), tokens.cast("int").alias("tokens"))


def _span_chunks(s: Column, start: Column, end: Column, p: Packing) -> Column:
    return F.transform(
        word_spans(s, start, end, p),
        lambda r: _chunk(
            join_slice(s["words"], r["from_word"], r["to_word"], " "),
            p.counter.known_tokens(r["from_word"], r["to_word"]),
        ),
    )


def packed_chunks(s: Column, p: Packing) -> Column:
    """Chunks of a prepared section: its segments packed, whatever its size.

    Chunks are ``struct<text, tokens>``; ``tokens`` is null if the counter has to count
    the text itself.
    """

    def cut(r: Column) -> Column:
        carried = join_slice(s["words"], r["from_word"], r["to_word"], " ")
        whole = join_slice(s["segments"], r["from_segment"], r["to_segment"], " ")
        text = (
            F.when(r["from_word"] == r["to_word"], whole)
            .when(r["from_segment"] == r["to_segment"], carried)
            .otherwise(F.concat(carried, F.lit(" "), whole))
        )
        tokens = p.counter.known_tokens(r["from_word"], r["end_word"])
        return F.when(
            r["forced"], _span_chunks(s, r["from_word"], r["to_word"], p)
        ).otherwise(F.array(_chunk(text, tokens)))

    return F.flatten(F.transform(pack_ranges(s, p), cut))


def section_chunks(s: Column, p: Packing) -> Column:
    """Chunks of a prepared section: one if it fits the budget, else packed."""
    whole = _chunk(s["text"], p.counter.known_tokens(F.lit(0), s["n_words"]))
    return F.when(p.counter.section_tokens(s) <= p.chunk_size, F.array(whole)).otherwise(
        packed_chunks(s, p)
    )


def _texts(chunks: Column) -> Column:
    return F.transform(chunks, lambda c: c["text"])


def words_per_segment(segments: Column, unusual: Column | None = None) -> Column:
    return F.transform(segments, lambda x: F.size(words(x, unusual)))


def _with_segments(text: Column, section: Column, all_words: Column, segments: Column) -> Column:
    """A prepared section, given its words and segments."""
    return let(
        segments,
        lambda segs: F.struct(
            section.alias("section"),
            text.alias("text"),
            F.size(all_words).alias("n_words"),
            all_words.alias("words"),
            segs.alias("segments"),
            words_per_segment(segs).alias("segment_words"),
        ),
    )


def recursive_segments(text: Column) -> Column:
    """Paragraphs of a text, or its sentences if it is a single paragraph."""
    return let(
        split_paragraphs(text),
        lambda ps: F.when(F.size(ps) == 1, split_sentences(text)).otherwise(ps),
    )


NO_STRINGS = "array<string>"


def worded_section(section: Column, text: Column, unusual: Column, p: Packing) -> Column:
    """A section with its number of words and, if it may exceed the budget, the words."""

    def with_words(ws: Column) -> Column:
        over = p.counter.may_exceed(text, ws, p.chunk_size)
        return F.struct(
            section.alias("section"),
            text.alias("text"),
            F.size(ws).alias("n_words"),
            F.when(over, ws).otherwise(F.array().cast(NO_STRINGS)).alias("words"),
        )

    return let(words(text, unusual), with_words)


def segments_of(s: Column, p: Packing) -> Column:
    """Segments of a worded section that may exceed the budget; else none."""
    return F.when(F.size(s["words"]) > 0, (p.split or recursive_segments)(s["text"])).otherwise(
        F.array().cast(NO_STRINGS)
    )


def _add(
    rows: DataFrame, out: str, prepared: Column, body: Callable[[Column], Column], p: Packing
) -> DataFrame:
    """Add ``body`` of a prepared section, measured by the counter, as column ``out``."""
    if p.counter.in_python:
        small_batches(rows.sparkSession)
    held = materialize(rows, F.array(prepared), "_prepared")
    measured = held.withColumn("_measured", p.counter.measure(F.col("_prepared")))
    return measured.withColumn(out, let(F.get("_measured", F.lit(0)), body)).drop(
        "_prepared", "_measured"
    )


def recursive_split(rows: DataFrame, text: str, out: str, p: Packing = Packing()) -> DataFrame:
    """Chunks of section texts: whole, or by paragraphs, sentences or words."""
    prepared = let(
        words(F.col(text)),
        lambda ws: _with_segments(F.col(text), F.lit(""), ws, (p.split or recursive_segments)(F.col(text))),
    )
    return _add(rows, out, prepared, lambda s: _texts(section_chunks(s, p)), p)


def pack_segments(rows: DataFrame, segments: str, out: str, p: Packing = Packing()) -> DataFrame:
    """Chunks of arrays of stripped segments, packed greedily with overlap."""
    prepared = let(
        F.col(segments),
        lambda segs: _with_segments(
            F.lit(""), F.lit(""), F.flatten(F.transform(segs, lambda x: words(x))), segs
        ),
    )
    return _add(rows, out, prepared, lambda s: _texts(packed_chunks(s, p)), p)


def _only_words(text: Column) -> Column:
    nothing = F.array().cast(NO_STRINGS)
    return let(words(text), lambda ws: _with_segments(text, F.lit(""), ws, nothing))


def force_split(rows: DataFrame, text: str, out: str, p: Packing = Packing()) -> DataFrame:
    """Chunks of texts cut word by word, as is done with segments over the budget."""

    def body(s: Column) -> Column:
        return _texts(_span_chunks(s, F.lit(0), F.size(s["words"]), p))

    return _add(rows, out, _only_words(F.col(text)), body, p)


def overlap_tail(rows: DataFrame, pieces: str, out: str, p: Packing = Packing()) -> DataFrame:
    """The end of a chunk, given as pieces, that the next chunk repeats.

    The whole chunk if it is no longer than the overlap, else its last words.
    """

    def tail(s: Column) -> Column:
        n = F.size(s["words"])
        start = p.counter.tail_start(s, F.lit(0), n, p.overlap)
        return F.when(p.counter.section_tokens(s) <= p.overlap, s["text"]).otherwise(
            join_slice(s["words"], start, n, " ")
        )

    return _add(rows, out, let(F.array_join(pieces, " "), _only_words), tail, p)
