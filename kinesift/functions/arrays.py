"""Array arithmetic as column expressions (all double)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it: lambdas compute expressions again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def sum_squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def deviations(a: Column) -> Column:
    m = mean(a)
    return F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(m, F.size(a)).alias("m")), lambda s: s["x"] - s["m"])


def std_pop(a: Column) -> Column:
    """Population standard deviation, two passes."""
    return F.sqrt(sum_squares(deviations(a)) / F.size(a))


def rms(a: Column) -> Column:
    return F.sqrt(sum_squares(a) / F.size(a))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def first_argmax(a: Column) -> Column:
    """0-based position of the first largest element; NULL for an empty array."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)).cast("int") - 1)


def top_margin(scores: Column) -> Column:
    """Largest minus second largest; 0 with fewer than two scores."""
    ordered = F.sort_array(scores, asc=False)
    return F.when(F.size(scores) >= 2, F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))).otherwise(F.lit(0.0))


def item(a: Column, index0: Column) -> Column:
    """Element at a 0-based index; NULL when the index is NULL or outside the array."""
    return F.get(a, index0.cast("int"))


def one_hot(value: Column, vocabulary: list[str]) -> Column:
    return F.array(*[F.when(value == v, 1.0).otherwise(0.0) for v in vocabulary])
