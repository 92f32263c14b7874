"""Removal of markup left-overs from plain-text papers, as one projection.

The steps run in a fixed order because each one sees the result of the one before.
All patterns use Unix-lines mode so that only ``\\n`` ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import let, strip

# The markup that is removed, in the order of removal.
OPTION_LINE = r"(?md)^\[.*?\].*?$"
DELETED_COMMANDS = ("usepackage", "documentclass", "begin", "end")
UNWRAPPED_HEADINGS = ("section", "subsection")
UNWRAPPED_COMMANDS = ("cite", "ref", "label")
ARTIFACT_LINE = "document"
MIN_LINE_LENGTH = 3


def _only_with(c: Column, needle: str, cleaned: Column) -> Column:
    """Texts without ``needle`` are left alone, which a plain substring search settles."""
    return F.when(F.contains(c, F.lit(needle)), cleaned).otherwise(c)


def drop_option_lines(c: Column) -> Column:
    """Blank every line that starts, in column 0, with a bracketed option list."""
    return _only_with(c, "[", F.regexp_replace(c, OPTION_LINE, ""))


def drop_commands(c: Column) -> Column:
    """Delete whole commands, unwrap headings and references, drop other backslashes."""
    out = c
    for name in DELETED_COMMANDS:
        out = F.regexp_replace(out, rf"(?d)\\{name}\{{.*?\}}", "")
    for name in UNWRAPPED_HEADINGS:
        out = F.regexp_replace(out, rf"\\{name}\*?\{{", "")
    for name in UNWRAPPED_COMMANDS:
        out = F.replace(out, F.lit(f"\\{name}{{"), F.lit(""))
    out = F.replace(out, F.lit("\\"), F.lit(""))
    return _only_with(c, "\\", out)


def drop_braces(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("{"), F.lit("")), F.lit("}"), F.lit(""))


def collapse_spaces(c: Column) -> Column:
    """Squeeze runs of the space character; tabs stay."""
    return _only_with(c, "  ", F.regexp_replace(c, "  +", " "))


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def content_lines(c: Column) -> Column:
    """Split into stripped lines, without the short ones and the left-over markers."""
    return F.filter(
        F.transform(F.split(c, "\n"), strip),
        lambda line: (F.length(line) >= MIN_LINE_LENGTH)
        & ~F.startswith(line, F.lit("["))
        & (line != ARTIFACT_LINE),
    )


def drop_artifact_lines(c: Column) -> Column:
    return F.array_join(content_lines(c), "\n")


def clean_lines(c: Column) -> Column:
    """The whole cleaning chain, leaving the text as an array of lines.

    ``collapse_newlines`` is left out: the line filter drops blank lines anyway.
    """
    # Steps that name their input twice get it bound, so that it is evaluated once.
    text = let(drop_option_lines(c), drop_commands)
    return content_lines(let(drop_braces(text), collapse_spaces))


def clean_text(c: Column) -> Column:
    """The whole cleaning chain: raw text in, cleaned text out."""
    return F.array_join(clean_lines(c), "\n")
