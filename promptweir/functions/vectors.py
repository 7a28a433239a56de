"""Vector arithmetic on array columns, always in DOUBLE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; NULL when either vector is missing or all zero."""
    scale = norm(left) * norm(right)
    return F.when(scale > 0, dot(left, right) / scale)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound. What a lambda captures is otherwise evaluated anew
    for every element it visits."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(vector: Column) -> Column:
    """The vector scaled to length one; NULL for a zero vector."""
    return let(norm(vector), lambda length: F.when(
        length > 0, F.transform(vector, lambda x: x.cast("double") / length)))
