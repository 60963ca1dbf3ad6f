"""Sequence helpers: what one asks of a list, on array columns, as Spark expressions.

Indexes count from 0; negative ones from the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(a: Column, i: int) -> Column:
    return F.try_element_at(a, F.lit(i + 1 if i >= 0 else i))


def index_of(a: Column, v: Column) -> Column:
    """The first index of a value, or -1."""
    return F.coalesce(F.array_position(a, v), F.lit(0)).cast("int") - 1


def last_index_of(a: Column, v: Column) -> Column:
    p = F.coalesce(F.array_position(F.reverse(a), v), F.lit(0)).cast("int")
    return F.when(p == 0, -1).otherwise(F.size(a) - p)


def includes(a: Column, v: Column) -> Column:
    return F.array_contains(a, v)


def find(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(a, f), F.lit(1))


def find_index(a: Column, f: Callable[[Column], Column]) -> Column:
    hits = F.filter(F.transform(a, lambda x, i: F.when(f(x), i)), lambda i: i.isNotNull())
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(-1))


def every(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.forall(a, f)


def some(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.exists(a, f)


def keep(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.filter(a, f)


def part(a: Column, start: int, end: int | None = None) -> Column:
    """Elements start to end - 1."""
    n = F.size(a)
    lo = F.greatest(n + start, F.lit(0)) if start < 0 else F.least(F.lit(start), n)
    hi = n if end is None else F.greatest(n + end, F.lit(0)) if end < 0 else F.least(F.lit(end), n)
    return F.when(hi > lo, F.slice(a, lo + 1, F.greatest(hi - lo, F.lit(0)))).otherwise(F.slice(a, 1, 0))


def join(a: Column, separator: str = ",") -> Column:
    return F.array_join(a, separator, "")


def concat(*a: Column) -> Column:
    return F.concat(*a)


def entries(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.struct(i.alias("index"), x.alias("value")))


def reduce(a: Column, zero: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(a, zero, f)


def push(a: Column, *v: Column) -> Column:
    return F.concat(a, F.array(*v))


def pop(a: Column) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))


def shift(a: Column) -> Column:
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def unshift(a: Column, *v: Column) -> Column:
    return F.concat(F.array(*v), a)


def fill(a: Column, v: Column) -> Column:
    return F.transform(a, lambda _: v)


def splice(a: Column, start: int, gone: int, *v: Column) -> Column:
    new = F.array(*v) if v else F.slice(a, 1, 0)
    return F.concat(part(a, 0, start), new, part(a, start + gone))
