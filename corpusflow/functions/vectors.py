"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import let

# Fixed value: decimals kept of a score. Scores are rounded before they are ranked, so that
# ties break by key whatever order the products were summed in.
SCORE_DIGITS = 6

# Fixed value: vector length of the reference configuration.
DIMENSION = 384


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def score(a: Column, b: Column) -> Column:
    return F.round(inner_product(a, b), SCORE_DIGITS)


def l2_normalize(v: Column) -> Column:
    """Scale to length one; the zero vector stays zero."""
    norm = F.sqrt(inner_product(v, v))
    return let(
        F.struct(v.alias("v"), norm.alias("norm")),
        lambda s: F.transform(
            s["v"],
            lambda x: F.when(s["norm"] > 0, x.cast("double") / s["norm"]).otherwise(F.lit(0.0)),
        ),
    )


def plain_words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def finite(vector: Column) -> Column:
    """Whether a vector is known in all its entries; others cannot be scored."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
