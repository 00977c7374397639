"""List functions with the conventions of a rules language: 1-based places, ends excluded, typed zeros."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column, kind: str = "bigint") -> Column:
    """The sum; of an empty list zero."""
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind))


def zip_map(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of the elements side by side; lists of unequal length raise."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f)).otherwise(F.raise_error(F.lit("lists of unequal length")))


def reduce_or(values: Column, f: Callable[[Column, Column], Column], default: Column) -> Column:
    """The list folded from its first element; an empty one gives default."""
    rest = F.slice(values, 2, F.greatest(F.size(values), F.lit(1)))
    return F.when(F.size(values) == 0, default).otherwise(F.aggregate(rest, F.get(values, F.lit(0)), f))


def largest_or(values: Column, default: Column) -> Column:
    return F.coalesce(F.array_max(values), default)


def smallest_or(values: Column, default: Column) -> Column:
    return F.coalesce(F.array_min(values), default)


def arg_least(values: Column, key: Callable[[Column], Column]) -> Column:
    """The first element of least key, or null."""
    keyed = F.transform(values, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.array_min(keyed)["x"]


def sequence(begin: Column, end: Column) -> Column:
    """begin up to, without, end; empty where there is nothing between."""
    return F.when(begin < end, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<bigint>"))


def nth(values: Column, place: Column) -> Column:
    """The element at a place counted from 1; null beyond either end."""
    return F.get(values, (place - 1).cast("int"))


def last(values: Column) -> Column:
    return F.get(values, F.size(values) - 1)


def without_nth(values: Column, place: Column) -> Column:
    """The list without the element at a place; beyond either end unchanged."""
    return F.filter(values, lambda x, i: i != place - 1)


def every(values: Column, test: Callable[[Column], Column]) -> Column:
    """True for an empty list."""
    return F.forall(values, test)
