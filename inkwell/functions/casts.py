"""Tolerant casts as Column expressions: null instead of a failure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: Column) -> Column:
    """A finite double."""
    d = x.try_cast("double")
    return F.when(F.abs(d) < float("inf"), d)


def integer(x: Column) -> Column:
    return x.try_cast("bigint")


def numbers(items: Column, count: int) -> Column:
    """An array of exactly ``count`` finite doubles (a rectangle of 4, a matrix of 6, a colour of 3 or 4)."""
    all_ = F.transform(items, number)
    return F.when((F.size(all_) == count) & F.forall(all_, lambda v: v.isNotNull()), all_)


def rectangles(items: Column) -> Column:
    """A flat array cut into rectangles; null unless its length is a multiple of four."""
    return F.when(F.size(items) % 4 == 0, F.transform(F.sequence(F.lit(0), (F.size(items) / 4).cast("int") - 1), lambda i: numbers(F.slice(items, i * 4 + 1, 4), 4)))


def pieces(items: Column, n: int) -> Column:
    """Groups of n; a remainder is dropped."""
    count = F.floor(F.size(items) / n).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(items, i * n + 1, n))).otherwise(F.slice(F.array(items), 1, 0))


def unsigned(x: Column) -> Column:
    """A big-endian unsigned integer of up to seven bytes; 0 for none."""
    return F.coalesce(F.conv(F.hex(x), 16, 10).cast("bigint"), F.lit(0))


def signed_to_unsigned(x: Column, bits: int) -> Column:
    """A value that was stored with its sign bit set, as the unsigned number."""
    return F.when(x > 0, x).otherwise(x + 2**bits)
