"""Headers, sections, paragraphs and sentences as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import WS, join_slice, let, strip

# What makes a line a header, and how sections are named.
HEADER_WORDS = (
    "abstract",
    "introduction",
    "methods?",
    "methodology",
    "results?",
    "discussion",
    "conclusion",
    "references?",
    "acknowledgments?",
)
NUMBERED_HEADER = rf"\p{{Nd}}+\.?{WS}+[A-Z]"
CAPITALS_HEADER = rf"[A-Z][A-Z{WS[1:-1]}]{{3,}}\z"
HEADER = rf"(?iu)^(?:(?:{'|'.join(HEADER_WORDS)})\z|{NUMBERED_HEADER}|{CAPITALS_HEADER})"
MAX_HEADER_LENGTH = 100
SECTION_NAME_LENGTH = 50
FIRST_SECTION = "introduction"
NO_SECTION = "unknown"
HINT_LINES = 5


def looks_like_header(stripped_line: Column) -> Column:
    """Header test of a stripped line, without the length limit.

    Case is ignored for all three forms, so any line of letters and spaces passes.
    """
    return F.rlike(F.lower(stripped_line), F.lit(HEADER))


def is_header(stripped_line: Column) -> Column:
    return (F.length(stripped_line) < MAX_HEADER_LENGTH) & looks_like_header(stripped_line)


def section_name(stripped_line: Column) -> Column:
    return F.substring(stripped_line, 1, SECTION_NAME_LENGTH)


def section_hint(text: Column) -> Column:
    """Name of the first header among the first five lines of a text."""
    lines = F.transform(F.slice(F.split(strip(text), "\n"), 1, HINT_LINES), strip)
    return F.coalesce(
        section_name(F.get(F.filter(lines, looks_like_header), F.lit(0))), F.lit(NO_SECTION)
    )


def header_positions(stripped_lines: Column) -> Column:
    """0-based positions of the headers among stripped lines."""
    return F.array_compact(F.transform(stripped_lines, lambda line, i: F.when(is_header(line), i)))


def cut_sections(lines: Column, headers: Column) -> Column:
    """Group lines into ``array<struct<section, text>>``, given where the headers are.

    Sections are slices between the headers, so the work is linear in the number of lines.
    A header without lines of its own gives no section; a text of headers only is one
    section without a name.
    """
    starts = F.concat(F.array(F.lit(-1)), headers)
    ends = F.concat(headers, F.array(F.size(lines)))
    bounds = F.filter(
        F.arrays_zip(starts.alias("header"), ends.alias("end")),
        lambda b: b["end"] > b["header"] + 1,
    )
    cut = F.transform(
        bounds,
        lambda b: F.struct(
            F.when(b["header"] < 0, F.lit(FIRST_SECTION))
            .otherwise(section_name(strip(F.get(lines, b["header"]))))
            .alias("section"),
            join_slice(lines, b["header"] + 1, b["end"], "\n").alias("text"),
        ),
    )
    whole = F.array(
        F.struct(F.lit(NO_SECTION).alias("section"), F.array_join(lines, "\n").alias("text"))
    )
    return F.when(F.size(headers) == F.size(lines), whole).otherwise(cut)


def split_sections(text: Column) -> Column:
    """Sections of a text as ``array<struct<section, text>>``."""

    def cut(lines: Column) -> Column:
        headers = header_positions(F.transform(lines, strip))
        return let(
            F.struct(lines.alias("lines"), headers.alias("headers")),
            lambda v: cut_sections(v["lines"], v["headers"]),
        )

    return let(F.split(text, "\n"), cut)


def split_paragraphs(text: Column) -> Column:
    return F.filter(
        F.transform(F.split(text, rf"\n{WS}*\n"), strip), lambda p: p != ""
    )


def split_sentences(text: Column) -> Column:
    # The split takes all white space behind a sentence, so only the ends need stripping.
    return F.array_remove(F.split(strip(text), rf"(?<=[.!?]){WS}+"), "")
