"""Points and boxes as struct columns. An integer box counts both ends; a float box is max - min wide."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def point(x, y) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def add(a: Column, b: Column) -> Column:
    return point(a.x + b.x, a.y + b.y)


def subtract(a: Column, b: Column) -> Column:
    return point(a.x - b.x, a.y - b.y)


def box(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return F.struct(min_x.alias("min_x"), min_y.alias("min_y"), max_x.alias("max_x"), max_y.alias("max_y"))


def is_empty(b: Column) -> Column:
    return (b.max_x < b.min_x) | (b.max_y < b.min_y)


def intersect(a: Column, b: Column) -> Column:
    return box(F.greatest(a.min_x, b.min_x), F.greatest(a.min_y, b.min_y), F.least(a.max_x, b.max_x), F.least(a.max_y, b.max_y))


def union(a: Column, b: Column) -> Column:
    return box(F.least(a.min_x, b.min_x), F.least(a.min_y, b.min_y), F.greatest(a.max_x, b.max_x), F.greatest(a.max_y, b.max_y))


def normalize(b: Column) -> Column:
    """Ends in order."""
    return box(F.least(b.min_x, b.max_x), F.least(b.min_y, b.max_y), F.greatest(b.min_x, b.max_x), F.greatest(b.min_y, b.max_y))


def size_int(b: Column) -> Column:
    """Width and height of an integer box; 0 where it is empty."""
    return point(F.when(is_empty(b), 0).otherwise(b.max_x - b.min_x + 1), F.when(is_empty(b), 0).otherwise(b.max_y - b.min_y + 1))


def size_float(b: Column) -> Column:
    return point(b.max_x - b.min_x, b.max_y - b.min_y)
