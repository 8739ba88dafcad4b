"""Vector functions on ``array<float>`` columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkmill.functions.text import col


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column | str) -> Column:
    return F.sqrt(
        F.aggregate(
            col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
        )
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; null when either has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def is_zero(a: Column | str) -> Column:
    return ~F.exists(col(a), lambda x: x != 0)


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)
