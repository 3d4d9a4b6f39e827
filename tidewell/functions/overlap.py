"""Column functions that compare two arrays: as sets, as multisets, or in order. The variants stay apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import once


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def common(a: Column, b: Column) -> Column:
    """Size of the sets' intersection."""
    return F.size(F.array_intersect(a, b))


def common_counted(a: Column, b: Column) -> Column:
    """Size of the multisets' intersection.

    Both are sorted and each item numbered among its equals; then equal pairs of item and number are the
    intersection of two sets.
    """

    def counted(items: Column) -> Column:
        number = lambda s: F.transform(s, lambda x, i: F.struct(x.alias("item"), (i - F.array_position(s, x) + 1).alias("n")))
        return once(F.array_sort(items), number)

    return F.size(F.array_intersect(counted(a), counted(b)))


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def set_f1(a: Column, b: Column) -> Column:
    n = common(a, b)
    return f1(ratio(n, F.size(F.array_distinct(a))), ratio(n, F.size(F.array_distinct(b))))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)


def cosine(a: Column, b: Column) -> Column:
    return ratio(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
