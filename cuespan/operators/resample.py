"""Weighted taps, scaling and cadence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def convolve(df: DataFrame, keys: list[str], index: str, value: str, taps: list[tuple[int, float]]) -> DataFrame:
    """out[i] = sum of in[i + k] * w over the taps (k, w), for each i that some tap reaches."""
    t = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in taps]))
    out = df.withColumn("_t", t).select(*keys, (F.col(index) - F.col("_t.k")).alias(index), (F.col(value) * F.col("_t.w")).alias(value))
    return out.groupBy(*keys, index).agg(F.sum(value).alias(value))


def subsample(df: DataFrame, keys: list[str], index: str, value: str, taps: list[tuple[int, float]], step: int) -> DataFrame:
    """convolve at every step-th index, numbered anew; taps that fall elsewhere are never made."""
    t = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in taps]))
    out = df.withColumn("_t", t).withColumn("_i", F.col(index) - F.col("_t.k")).where(F.pmod("_i", F.lit(step)) == 0)
    out = out.select(*keys, F.call_function("div", F.col("_i"), F.lit(step)).alias(index), (F.col(value) * F.col("_t.w")).alias(value))
    return out.groupBy(*keys, index).agg(F.sum(value).alias(value))


def scale(df: DataFrame, keys: list[str], x: str, y: str, value: str, fx: float, fy: float, target: tuple[float, float] = (0, 0), source: tuple[float, float] = (0, 0), rect: tuple[int, int, int, int] | None = None) -> DataFrame:
    """A picture scaled by fx and fy with a triangle filter, one axis after the other, the smaller factor
    first, so that its point `source` comes to `target`; rect (min x, min y, max x, max y, ends counted) is the part of
    it that is read. A factor of 0 gives nothing; 1 leaves an axis alone where both points are the same on it."""
    if not fx or not fy:
        return df.limit(0)
    if rect is not None:
        df = df.where(F.col(x).between(rect[0], rect[2]) & F.col(y).between(rect[1], rect[3]))
    for axis, f, to, at in sorted(((x, fx, target[0], source[0]), (y, fy, target[1], source[1])), key=lambda p: p[1]):
        if f == 1 and to == at:
            continue
        other = [c for c in (x, y) if c != axis]
        reach = 1.0 / min(f, 1.0)
        lo, hi = F.ceil((F.col(axis) - at - reach) * f + to), F.floor((F.col(axis) - at + reach) * f + to)
        out = df.withColumn("_o", F.explode(F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))))
        w = F.greatest(F.lit(0.0), 1 - F.abs((F.col("_o") - to) / F.lit(float(f)) + at - F.col(axis)) / reach)
        out = out.groupBy(*keys, *other, F.col("_o").alias(axis)).agg((F.sum(F.col(value) * w) / F.sum(w)).alias(value), F.sum(w).alias("_w")).where("_w > 0").drop("_w")
        df = out.select(*keys, x, y, value)
    return df


def pulldown(frame: Column, cadence: int) -> tuple[Column, Column]:
    """The source frames of the even and odd rows of an output frame when 2:3 pulldown is taken out.

    Five source frames hold four film frames A to D as AA BB BC CD DD; the source starts at `cadence`
    in that order. A film frame that the start cuts is left out, so a source from CD on starts with D.
    """
    film = frame.cast("long") + min(cadence, 3)
    letter = F.pmod(film, F.lit(4))
    cycle = F.call_function("div", film - letter, F.lit(4))
    first_field = F.when(letter < 2, letter).otherwise(letter + 1)
    second_field = F.when(letter == 2, letter).otherwise(first_field)
    return cycle * 5 + first_field - cadence, cycle * 5 + second_field - cadence


def pulled_length(length: Column, cadence: int) -> Column:
    """Whole film frames in so many source frames: the split frame BC adds none by itself."""
    rest = F.pmod(length, F.lit(5))
    return F.call_function("div", length - rest, F.lit(5)) * 4 + rest - F.when(rest > (2 - cadence) % 5, 1).otherwise(0)
