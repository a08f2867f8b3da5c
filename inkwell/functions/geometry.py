"""Geometry, number formats and casts as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Box:
    """A box of four columns."""

    left: str
    low: str
    right: str
    high: str

    x0 = property(lambda self: F.col(self.left))
    y0 = property(lambda self: F.col(self.low))
    x1 = property(lambda self: F.col(self.right))
    y1 = property(lambda self: F.col(self.high))
    width = property(lambda self: self.x1 - self.x0)
    height = property(lambda self: self.y1 - self.y0)
    area = property(lambda self: self.width * self.height)
    empty = property(lambda self: (self.width <= 0) | (self.height <= 0))


def rounded(x: Column) -> Column:
    """The nearest whole number, halves away from zero, as ``round`` gives it; without decimal numbers on the way, which cost more than reading a glyph."""
    low, high = F.floor(x), F.ceil(x)
    return F.when(x < 0, high - F.when(high - x >= 0.5, 1).otherwise(0)).otherwise(low + F.when(x - low >= 0.5, 1).otherwise(0))


def overlaps_h(a: Box, b: Box) -> Column:
    return (b.x0 <= a.x1) & (a.x0 <= b.x1)


def overlaps_v(a: Box, b: Box) -> Column:
    return (b.y0 <= a.y1) & (a.y0 <= b.y1)


def _edge_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.least(F.abs(a0 - b1), F.abs(a1 - b0))


def overlap_h(a: Box, b: Box) -> Column:
    """The smaller distance of opposite edges where both overlap, else 0."""
    return F.when(overlaps_h(a, b), _edge_gap(a.x0, a.x1, b.x0, b.x1)).otherwise(0.0)


def overlap_v(a: Box, b: Box) -> Column:
    return F.when(overlaps_v(a, b), _edge_gap(a.y0, a.y1, b.y0, b.y1)).otherwise(0.0)


def distance_h(a: Box, b: Box) -> Column:
    return F.when(overlaps_h(a, b), 0.0).otherwise(_edge_gap(a.x0, a.x1, b.x0, b.x1))


def distance_v(a: Box, b: Box) -> Column:
    return F.when(overlaps_v(a, b), 0.0).otherwise(_edge_gap(a.y0, a.y1, b.y0, b.y1))


def between(a: Box, b: Box) -> tuple[Column, Column]:
    """What lies between two boxes along both axes; the vector between their middles if they overlap along both."""
    wide = F.greatest(a.x1, b.x1) - F.least(a.x0, b.x0) - a.width - b.width
    high = F.greatest(a.y1, b.y1) - F.least(a.y0, b.y0) - a.height - b.height
    both = (wide < 0) & (high < 0)
    return F.when(both, (a.x0 + a.x1 - b.x0 - b.x1) / 2).otherwise(F.greatest(wide, F.lit(0))), F.when(both, (a.y0 + a.y1 - b.y0 - b.y1) / 2).otherwise(F.greatest(high, F.lit(0)))


def hull_waste(a: Box, b: Box) -> Column:
    """Area of the hull of both less their areas; negative where they overlap."""
    hull = (F.greatest(a.x1, b.x1) - F.least(a.x0, b.x0)) * (F.greatest(a.y1, b.y1) - F.least(a.y0, b.y0))
    return hull - a.area - b.area


def compose(m1: list[Column], m0: list[Column]) -> list[Column]:
    """The six numbers of m1 followed by m0."""
    a, b, c, d, e, f = m1
    p, q, r, s, t, u = m0
    return [a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u]


def translate(m: list[Column], x: Column, y: Column) -> list[Column]:
    return [*m[:4], x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]]


def apply_point(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def apply_norm(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    return x * m[0] + y * m[2], x * m[1] + y * m[3]


def apply_rect(m: list[Column], x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column, Column]:
    """Hull of the transformed corners."""
    corners = [apply_point(m, x, y) for x in (x0, x1) for y in (y0, y1)]
    xs, ys = zip(*corners, strict=True)
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


# Roman digits by place.
ROMAN = (("m",), ("c", "d", "m"), ("x", "l", "c"), ("i", "v", "x"))


def roman(n: Column) -> Column:
    """Lower-case Roman numerals of 1 to 3999, else null."""

    def digit(d: Column, one: str, five: str = "", ten: str = "") -> Column:
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.element_at(F.array(*map(F.lit, forms)), d + 1)

    parts = [digit(F.floor(n / 10**k).cast("int") % 10, *signs) for k, signs in zip((3, 2, 1, 0), ROMAN, strict=True)]
    return F.when((n >= 1) & (n <= 3999), F.concat(*parts))


def alpha(n: Column) -> Column:
    """a to z, aa, ab, …: bijective base 26 of a positive number (up to seven letters), else null."""
    letters, rest, going = [], n.cast("long"), n > 0
    for _ in range(7):
        letters.append(F.when(going, F.chr(F.lit(97) + (rest - 1) % 26)).otherwise(""))
        rest = F.floor((rest - 1) / 26)
        going = going & (rest > 0)
    return F.when(n > 0, F.concat(*reversed(letters)))


def page_label(style: Column, prefix: Column, value: Column) -> Column:
    body = F.when(style == "D", value.cast("string")).when(style == "R", F.upper(roman(value))).when(style == "r", roman(value)).when(style == "A", F.upper(alpha(value))).when(style == "a", alpha(value)).otherwise("")
    return F.concat(F.coalesce(prefix, F.lit("")), F.coalesce(body, F.lit("")))


def rect_text(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.format_string("%.3f,%.3f,%.3f,%.3f", x0, y0, x1, y1)


def matrix_text(m: list[Column]) -> Column:
    return F.format_string("[%.2f,%.2f,%.2f,%.2f, (%.2f,%.2f)]", *m)


def shorten(text: Column, size: int) -> Column:
    """The text itself, or its start and end around " ... "."""
    if size <= 7:
        return F.substring(text, 1, size)
    half = (size - 5) // 2
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, half), F.lit(" ... "), F.right(text, F.lit(half)))).otherwise(text)


def escape_markup(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x0c\x0e-\x1f]", "")
