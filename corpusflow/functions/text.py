"""Small text building blocks shared by the cleaning, splitting and packing columns.

Everything here is a ``Column -> Column`` helper made of built-in Spark functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that count as white space when a line is stripped or a
# text is cut into words (Unicode white space plus the four ASCII separators), as ranges.
WHITESPACE_RANGES = (
    (0x0009, 0x000D),
    (0x001C, 0x0020),
    (0x0085, 0x0085),
    (0x00A0, 0x00A0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)
WHITESPACE = "".join(chr(c) for lo, hi in WHITESPACE_RANGES for c in range(lo, hi + 1))
# The same set as a Java regex character class. Spelling it out keeps the match exact
# and spares the slower Unicode mode of the regex engine.
WS = "[" + "".join(rf"\u{lo:04x}-\u{hi:04x}" for lo, hi in WHITESPACE_RANGES) + "]"
# White space other than space and newline. The intersection lets common characters fail
# on three range tests.
UNUSUAL_WS = r"[\t\u000b-\u001f\u007f-￿&&" + WS + "]"


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(c, F.lit(WHITESPACE))


def has_unusual_space(c: Column) -> Column:
    """Whether a text holds other white space than spaces and newlines."""
    return F.rlike(c, F.lit(UNUSUAL_WS))


def words(c: Column, unusual: Column | None = None) -> Column:
    """Cut a text into its white-space separated words; a blank text has none.

    Without unusual white space it is cut at a single character, which Java does without a
    regex. ``unusual`` says so for the text that ``c`` is a part of, if that is known.
    """
    if unusual is None:
        unusual = has_unusual_space(c)
    plain = F.split(F.replace(c, F.lit("\n"), F.lit(" ")), " ")
    return F.array_remove(F.when(unusual, F.split(c, WS + "+")).otherwise(plain), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Catalyst inlines an aliased column into every place that uses it, including the body
    of a lambda, where it would then be evaluated once per element. Binding it as the
    variable of a one-element ``transform`` keeps it a single evaluation.
    """
    return F.transform(F.array(value), body)[0]


def join_slice(items: Column, start: Column, end: Column, separator: str) -> Column:
    """Join ``items[start:end]`` (0-based, end excluded) with ``separator``."""
    return F.array_join(F.slice(items, start + 1, end - start), separator)


def materialize(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column that is evaluated once, before the expressions that use it.

    The generator, of one row each, keeps the optimizer from merging the steps. Calls of
    Python functions need that: they cannot be evaluated within array expressions.
    """
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))
