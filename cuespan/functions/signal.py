"""Sample scaling, colour transfer and matrices, packing and filter taps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Luma weights of Rec. 709.
KR, KG, KB = 0.2126, 0.7152, 0.0722


#: White points and primaries (R, G, B) in xy-space, by their common names.
ILLUMINANTS = {"D50": (0.34567, 0.35850), "D65": (0.31271, 0.32902)}
PRIMARIES = {
    "AdobeRGB": ((0.64, 0.33), (0.21, 0.71), (0.15, 0.06)),
    "AppleRGB": ((0.625, 0.34), (0.28, 0.595), (0.15, 0.07)),
    "sRGB": ((0.64, 0.33), (0.3, 0.6), (0.15, 0.06)),
    "Rec709": ((0.64, 0.33), (0.3, 0.6), (0.15, 0.06)),
}


def _xy(p: tuple[float, float]) -> Column:
    return F.struct(F.lit(p[0]).alias("x"), F.lit(p[1]).alias("y"))


def illuminant(name: Column) -> Column:
    """The white point of that name, as (x, y); null if unknown."""
    return F.try_element_at(F.create_map(*[c for n, p in ILLUMINANTS.items() for c in (F.lit(n), _xy(p))]), name)


def thumbnail_box(full_frame: Column, active_area: Column) -> Column:
    """The box that thumbnails show: the active area, or the whole frame where none is given."""
    return F.coalesce(active_area, full_frame)


def primaries(name: Column) -> Column:
    """The primaries of that name, an array of three (x, y); null if unknown."""
    return F.try_element_at(F.create_map(*[c for n, p in PRIMARIES.items() for c in (F.lit(n), F.array(*map(_xy, p)))]), name)


def pcm(v: Column, kind: str) -> Column:
    """Stored samples as floats."""
    if kind == "u8":
        return v / F.lit(127.0) - 1
    return v / F.lit({"s16": 32767.0, "s32": 2147483647.0, "flt": 1.0, "dbl": 1.0}[kind])


def luma_float(v: Column) -> Column:
    return (v - 16) / F.lit(219.0)


def chroma_float(v: Column) -> Column:
    return (v - 128) / F.lit(224.0)


def luma_byte(v: Column) -> Column:
    return (v * 219 + 16).cast("int")


def chroma_byte(v: Column) -> Column:
    return (v * 224 + 128).cast("int")


def ycbcr(r: Column, g: Column, b: Column) -> list[Column]:
    """Y, Cb and Cr of Rec. 709."""
    y = r * KR + g * KG + b * KB
    return [y, (b - y) / F.lit(2 * (1 - KB)), (r - y) / F.lit(2 * (1 - KR))]


def rgb(y: Column, cb: Column, cr: Column) -> list[Column]:
    r, b = y + cr * (2 * (1 - KR)), y + cb * (2 * (1 - KB))
    return [r, (y - r * KR - b * KB) / F.lit(KG), b]


def rec709_to_linear(v: Column) -> Column:
    return F.when(v < 0.081, v / F.lit(4.5)).otherwise(F.pow((v + 0.099) / F.lit(1.099), F.lit(1 / 0.45)))


def linear_to_rec709(v: Column) -> Column:
    return F.when(v < 0.018, v * 4.5).otherwise(1.099 * F.pow(v, F.lit(0.45)) - 0.099)


def display_to_linear(v: Column) -> Column:
    return F.when(v < 0, F.lit(0.0)).otherwise(F.pow(v, F.lit(2.5)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def gamma45_byte(v: Column) -> Column:
    """0 to 255 by a 0.45 power ramp."""
    return F.floor(F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), F.lit(0.45)) * 255 + 0.5).cast("int")


def argb32(r: Column, g: Column, b: Column, a: Column) -> Column:
    """A premultiplied 8-bit pixel, alpha in the top byte, as a bigint."""
    a1 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))
    part = lambda v, k: F.shiftleft(gamma45_byte(v * a1).cast("long"), k)
    return F.shiftleft(F.floor(a1 * 255 + 0.5).cast("long"), 24).bitwiseOR(part(r, 16)).bitwiseOR(part(g, 8)).bitwiseOR(part(b, 0))


def triangle_taps(sub: float, offset: float = 0.0) -> list[tuple[int, float]]:
    """(place, weight) of a triangle filter about offset for a rate that is sub times as high.

    Towards a lower rate its half-width is 1 / sub and its weights sum to 1; towards a higher one it is sub
    and the weight at offset is 1, as sub - 1 new samples lie between two old ones."""
    if sub <= 0:
        raise ValueError("sub must be positive")
    width = 1.0 / sub if sub < 1 else float(sub)
    w = [(k, 1 - abs(k - offset) / width) for k in range(math.ceil(offset - width), math.floor(offset + width) + 1)]
    w = [(k, v) for k, v in w if v > 0]
    total = sum(v for _, v in w) if sub < 1 else 1.0
    return [(k, v / total) for k, v in w]


def lanczos_taps(sub: float, lobes: int = 3, offset: float = 0.0) -> list[tuple[int, float]]:
    """(place, weight) of a windowed sinc."""
    width = lobes / min(sub, 1.0)
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    w = [(k, sinc((k - offset) * lobes / width) * sinc((k - offset) / width)) for k in range(math.ceil(offset - width), math.floor(offset + width) + 1)]
    total = sum(v for _, v in w)
    return [(k, v / total) for k, v in w if abs(v) > 1e-12]
