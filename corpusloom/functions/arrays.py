"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector at length one; the zero vector stays as it is."""

    def divided(n: Column) -> Column:
        return F.transform(doubles(a), lambda x: x / F.when(n == 0, 1.0).otherwise(n))

    # The norm is an element of a list of one, so that it is computed once.
    return F.get(F.transform(F.array(norm(a)), divided), F.lit(0))


def rounded(a: Column, digits: int = 6) -> Column:
    return F.transform(doubles(a), lambda x: F.round(x, digits))
