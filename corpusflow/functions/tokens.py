"""Token counters: how long is a text, and how long are runs of its words?

Packing needs the token count of many overlapping stretches of one text. A counter
therefore measures every word and segment once and answers stretches from running sums.
What a stretch adds behind a space is the difference that it makes behind a plain word. That is
exact whenever nothing is merged across a space that follows something else, which holds for word
counts, character counts, byte-level encodings that attach a space to the word after it, encodings
that drop spaces, and piece models that put a mark in front of each word and of the text
(``tests/test_token_joins.py`` holds five encodings to it).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusflow.functions.text import words


@dataclass(frozen=True)
class WordCounter:
    """One token per word. Needs no measuring, so the whole pipeline stays in the JVM."""

    in_python = False

    def count(self, text: Column) -> Column:
        return F.size(words(text))

    def known_tokens(self, from_word: Column, to_word: Column) -> Column:
        """Tokens of a chunk made of these words, or null if its text must be counted."""
        return to_word - from_word

    def measure(self, sections: Column, budget: int | None = None) -> Column:
        """Sections with what packing has to know; those within ``budget`` tokens need little."""
        return sections

    def measure_error(self, sections: Column) -> Column:
        """Why the sections of a document could not be measured, or null."""
        return F.lit(None).cast("string")

    def count_texts(self, texts: Column) -> Column:
        """``struct<counts, error>`` of an array of texts; ``counts`` is null if all are known."""
        return F.lit(None).cast("struct<counts:array<int>,error:string>")

    def may_exceed(self, text: Column, all_words: Column, budget: int) -> Column:
        """False if the text is surely within the budget, so it needs no segments."""
        return F.size(all_words) > budget

    def section_tokens(self, s: Column) -> Column:
        return s["n_words"]

    def segment_tokens(self, s: Column, i: Column) -> Column:
        """Tokens of segment ``i`` alone."""
        return F.get(s["segment_words"], i)

    def joined_segments(self, s: Column, a: Column, b: Column, words_in: Column) -> Column:
        """Tokens of segments ``a..b-1`` joined by spaces; ``words_in`` is their word count."""
        return words_in

    def more_segments(self, s: Column, a: Column, b: Column, words_in: Column) -> Column:
        """The same for segments that follow other text."""
        return words_in

    def words_alone(self, s: Column, a: Column, b: Column) -> Column:
        """Sum of the counts of words ``a..b-1``, each taken alone."""
        return b - a

    def joined_words(self, s: Column, a: Column, b: Column) -> Column:
        """Tokens of words ``a..b-1`` joined by spaces."""
        return b - a

    def tail_start(self, s: Column, a: Column, b: Column, budget: int) -> Column:
        """First word of the longest tail of words ``a..b-1`` of at most ``budget`` tokens."""
        return F.greatest(a, b - budget)


SECTION_FIELDS = ("section", "text", "n_words", "words", "segments", "segment_words")
MEASURES = T.StructType(
    [T.StructField("tokens", T.IntegerType()), T.StructField("error", T.StringType())]
    + [
        T.StructField(name, T.ArrayType(T.IntegerType()))
        for name in ("words_own", "words_spaced", "segments_own", "segments_spaced")
    ]
)
COUNTS = T.StructType(
    [T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("error", T.StringType())]
)
FAILED = "token counter failed: "
#: Stretches whose counts a task keeps at a time, and their characters.
KEPT_COUNTS = 200_000
KEPT_CHARS = 4_000_000
#: Bytes of documents that a task holds as Python strings at a time, or one document.
PIECE_BYTES = 1 << 20


def _pieces(batches: Iterator[pa.Array]) -> Iterator[list]:
    """The rows of ``batches`` as Python values, a few at a time, however large the batches are."""
    for batch in batches:
        step = max(1, int(len(batch) * PIECE_BYTES / max(1, batch.nbytes)))
        for i in range(0, len(batch), step):
            yield batch.slice(i, step).to_pylist()


class _Counts(dict):
    """Counts of stretches, each of which is counted once."""

    def __init__(self, count: Callable[[str], int]):
        self.count = count
        self.chars = 0

    def __missing__(self, text: str) -> int:
        n = self.count(text)
        if len(self) >= KEPT_COUNTS or self.chars + len(text) > KEPT_CHARS:
            self.clear()
            self.chars = 0
        if len(text) <= KEPT_CHARS:
            self[text] = n
            self.chars += len(text)
        return n


#: A word that every counter takes, in front of what is counted behind a space.
LEAD = "a"


def _running_sums(counts: _Counts, items: list[str], spaced: bool) -> list[int]:
    """Sums of the counts of ``items``, each alone or behind a space."""
    lead, without = (f"{LEAD} ", counts[LEAD] if items else 0) if spaced else ("", 0)
    return np.cumsum([0] + [counts[lead + item] - without for item in items]).tolist()


class FunctionCounter:
    """Counts with a function ``str -> int``, such as a byte-pair encoding.

    ``factory`` builds the function once per Python worker. Each document crosses to
    Python in Arrow batches, once to be measured and once for the counts of its chunks;
    packing itself stays in the JVM. A document for which the function raises fails alone.
    """

    in_python = True

    def __init__(self, factory: Callable[[], Callable[[str], int]]):
        def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            count_text = factory()
            for texts in _pieces(batches):
                yield pa.array([None if t is None else count_text(t) for t in texts], pa.int32())

        def count_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            count_text = factory()

            def counts(texts: list[str] | None) -> dict:
                if texts is None:
                    return {"counts": None, "error": None}
                try:
                    return {"counts": [count_text(t) for t in texts], "error": None}
                except Exception as e:
                    return {"counts": None, "error": f"{FAILED}{e}"}

            for docs in _pieces(batches):
                yield pa.array([counts(t) for t in docs], to_arrow_type(COUNTS))

        def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            count_text = factory()
            counts = _Counts(count_text)

            def measures(s: dict, budget: int) -> dict:
                tokens, found = count_text(s["text"]), {}
                for items, own, spaced in (("words", "words_own", "words_spaced"), ("segments", "segments_own", "segments_spaced")):
                    over = s[items] if tokens > budget else []
                    found[own] = _running_sums(counts, over, False)
                    found[spaced] = _running_sums(counts, over, True)
                return {"tokens": tokens, **found}

            def measured(sections: list[dict] | None) -> list[dict] | None:
                try:
                    return sections and [measures(s, s["budget"]) for s in sections]
                except Exception as e:
                    return [{"error": f"{FAILED}{e}"}]

            kind = pa.list_(to_arrow_type(MEASURES))
            for docs in _pieces(batches):
                yield pa.array([measured(doc) for doc in docs], kind)

        def register(f, kind):
            return F.arrow_udf(f, kind)

        self._count = register(count, T.IntegerType())
        self._count_all = register(count_all, COUNTS)
        self._measure = register(measure, T.ArrayType(MEASURES))

    def count(self, text: Column) -> Column:
        return self._count(text)

    def known_tokens(self, from_word: Column, to_word: Column) -> Column:
        return F.lit(None)

    def measure(self, sections: Column, budget: int | None = None) -> Column:
        least = F.lit(-1 if budget is None else budget).alias("budget")
        needed = F.transform(
            sections, lambda s: F.struct(s["text"], s["words"], s["segments"], least)
        )
        return F.zip_with(
            sections,
            self._measure(needed),
            lambda s, m: F.struct(
                *(s[f] for f in SECTION_FIELDS),
                m.alias("m"),
            ),
        )

    def measure_error(self, sections: Column) -> Column:
        return F.get(sections, F.lit(0))["m"]["error"]

    def count_texts(self, texts: Column) -> Column:
        return self._count_all(texts)

    def may_exceed(self, text: Column, all_words: Column, budget: int) -> Column:
        # Only the function itself knows, so every section is cut before it is measured.
        return F.lit(True)

    def section_tokens(self, s: Column) -> Column:
        return s["m"]["tokens"]

    @staticmethod
    def _sum(sums: Column, a: Column, b: Column) -> Column:
        return F.get(sums, b) - F.get(sums, a)

    def _joined(self, own: Column, spaced: Column, a: Column, b: Column) -> Column:
        rest = self._sum(own, a, a + 1) + self._sum(spaced, a + 1, b)
        return F.when(b > a, rest).otherwise(F.lit(0))

    def segment_tokens(self, s: Column, i: Column) -> Column:
        return self._sum(s["m"]["segments_own"], i, i + 1)

    def joined_segments(self, s: Column, a: Column, b: Column, words_in: Column) -> Column:
        return self._joined(s["m"]["segments_own"], s["m"]["segments_spaced"], a, b)

    def more_segments(self, s: Column, a: Column, b: Column, words_in: Column) -> Column:
        return self._sum(s["m"]["segments_spaced"], a, b)

    def words_alone(self, s: Column, a: Column, b: Column) -> Column:
        return self._sum(s["m"]["words_own"], a, b)

    def joined_words(self, s: Column, a: Column, b: Column) -> Column:
        return self._joined(s["m"]["words_own"], s["m"]["words_spaced"], a, b)

    def tail_start(self, s: Column, a: Column, b: Column, budget: int) -> Column:
        own = s["m"]["words_own"]
        # Words may cost nothing, so the tail may have more words than the budget.
        candidates = F.sequence(a, b)
        return F.get(
            F.filter(candidates, lambda j: self._sum(own, j, b) <= budget), F.lit(0)
        )
