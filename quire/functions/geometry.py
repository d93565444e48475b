"""Rectangles in page space (y upwards) as structs of l, b, r, t."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Str = Column | str


def _c(x: Str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def region(left: Str, bottom: Str, right: Str, top: Str) -> Column:
    return F.struct(_c(left).alias("l"), _c(bottom).alias("b"), _c(right).alias("r"), _c(top).alias("t"))


def width(a: Column) -> Column:
    return a["r"] - a["l"]


def height(a: Column) -> Column:
    return a["t"] - a["b"]


def is_empty(a: Column) -> Column:
    return (width(a) <= 0) | (height(a) <= 0)


def union(a: Column, b: Column) -> Column:
    """G1: an empty rectangle adds nothing."""
    both = region(F.least(a["l"], b["l"]), F.least(a["b"], b["b"]), F.greatest(a["r"], b["r"]), F.greatest(a["t"], b["t"]))
    return F.when(is_empty(a), b).when(is_empty(b), a).otherwise(both)


def shares_line(a: Column, b: Column, tolerance: float) -> Column:
    """The vertical overlap is over ``tolerance`` of the lower height."""
    least = F.least(height(a), height(b))
    return (least > 0) & (F.least(a["t"], b["t"]) - F.greatest(a["b"], b["b"]) > tolerance * least)


def image_rectangle(left: Str, bottom: Str, right: Str, top: Str, page_width: Str, page_height: Str, scale: Str, padding: Str) -> dict[str, Column]:
    """Padded, clamped to the page, y downwards, scaled and rounded half to even."""
    x0, x1 = F.greatest(F.lit(0.0), _c(left) - _c(padding)), F.least(_c(page_width), _c(right) + _c(padding))
    y0 = F.greatest(F.lit(0.0), _c(page_height) - _c(top) - _c(padding))
    y1 = F.least(_c(page_height), _c(page_height) - _c(bottom) + _c(padding))
    whole = lambda x: F.bround(x * _c(scale), 0).cast("int")
    return {"x": whole(x0), "y": whole(y0), "width": whole(x1 - x0), "height": whole(y1 - y0)}


def pitch(x: Str, y: Str) -> Column:
    """Two octaves over 220 Hz, rightwards and upwards."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(v)))
    return 220 * F.pow(F.lit(2.0), unit(x) + (1 - unit(y)))
