"""Frame functions: a constant or expression of the frame, in place of per-frame callbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(v) -> Column:
    """A constant wherever a frame function may stand: a number, or up to four of them, padded with 0."""
    if isinstance(v, Column):
        return v
    if isinstance(v, (tuple, list)):
        if not 0 < len(v) <= 4:
            raise ValueError("a value has one to four parts")
        return F.array(*[F.lit(float(x)) for x in [*v, 0, 0, 0][:4]])
    return F.lit(float(v))


def linear(frame: Column, a: float, b: float) -> Column:
    return frame * F.lit(float(a)) + F.lit(float(b))


def lerp(frame: Column, start: list[float], end: list[float], length: float, clamp: bool = False) -> Column:
    """start to end over length; beyond its ends it goes on, or with clamp holds."""
    if length <= 0:
        raise ValueError("length must be positive")
    f = frame.cast("double") / F.lit(float(length))
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), f)) if clamp else f
    return F.array(*[f * F.lit(float(e) - float(s)) + F.lit(float(s)) for s, e in zip(start, end, strict=True)])


def shifted(frame: Column, offset: float) -> Column:
    return frame + F.lit(offset)


def as_int(v: Column) -> Column:
    """Halves away from zero."""
    return F.round(v).cast("int")


def as_point(v: Column) -> Column:
    """The first two of an array as a place (x, y)."""
    return F.struct(v[0].alias("x"), v[1].alias("y"))


def as_box(v: Column) -> Column:
    """An array of four as a box of whole numbers (min_x, min_y, max_x, max_y), halves away from zero."""
    return F.struct(*[as_int(v[i]).alias(n) for i, n in enumerate(("min_x", "min_y", "max_x", "max_y"))])


def as_rgba(v: Column) -> Column:
    """An array of four as a colour; alpha is held in 0 to 1."""
    return F.struct(v[0].alias("r"), v[1].alias("g"), v[2].alias("b"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v[3])).alias("a"))


def crossfade_weight(frame: Column, length: int) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), frame.cast("double") / length))
