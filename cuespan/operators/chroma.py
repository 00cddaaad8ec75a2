"""Whole colour pipelines: planar pictures with fewer chroma samples to linear colours and back.

Planes are tables by frame, row and column. Chroma taps are an explode and a sum by pixel, which Spark adds
up before the shuffle; both planes then meet by pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signal as sig
from .resample import convolve, subsample

PIXEL = ["frame", "y", "x"]
#: The first row of a picture belongs to the second field, so pictures lie one row higher.
TOP = -1


def _planes(pixels: DataFrame) -> DataFrame:
    """Linear colours (frame, y, x, r, g, b) as luma and chroma of coded colours."""
    coded = [sig.linear_to_rec709(F.col(c)) for c in "rgb"]
    y, cb, cr = sig.ycbcr(*coded)
    return pixels.select("frame", "y", "x", y.alias("luma"), cb.alias("cb"), cr.alias("cr"))


def reconstruct_411(luma: DataFrame, chroma: DataFrame, width: int) -> DataFrame:
    """Linear colours from byte planes: luma (frame, y, x, luma), and chroma (frame, y, x, cb, cr) at every fourth
    pixel. Chroma is spread over its neighbours by a triangle."""
    spread = chroma.select("frame", "y", (F.col("x") * 4).alias("x"), sig.chroma_float(F.col("cb")).alias("cb"), sig.chroma_float(F.col("cr")).alias("cr"))
    taps = [(-k, w) for k, w in sig.triangle_taps(4.0)]
    cb, cr = (convolve(spread.select(*PIXEL, c), ["frame", "y"], "x", c, taps) for c in ("cb", "cr"))
    full = luma.where(F.col("x") < width).join(cb, PIXEL, "left").join(cr, PIXEL, "left")
    r, g, b = sig.rgb(sig.luma_float(F.col("luma")), F.coalesce("cb", F.lit(0.0)), F.coalesce("cr", F.lit(0.0)))
    return full.select("frame", (F.col("y") + TOP).alias("y"), "x", *[sig.rec709_to_linear(c).alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))])


def subsample_411(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Byte planes from linear colours: luma, and chroma at every fourth pixel; fractions are cut off."""
    p = _planes(pixels).withColumn("y", F.col("y") - TOP)
    cb, cr = (subsample(p.select(*PIXEL, c), ["frame", "y"], "x", c, sig.triangle_taps(0.25), 4).where("x >= 0") for c in ("cb", "cr"))
    # at columns that fewer pixels reach, only those count
    at = p.groupBy("frame", "y").agg(F.max("x").alias("last"))
    c = cb.join(cr, PIXEL).join(at, ["frame", "y"]).where("4 * x <= last")
    return p.select(*PIXEL, sig.luma_byte(F.col("luma")).alias("luma")), c.select(*PIXEL, sig.chroma_byte(F.col("cb")).alias("cb"), sig.chroma_byte(F.col("cr")).alias("cr"))


def subsample_420_interlaced(pixels: DataFrame, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Luma, and chroma at half the columns and rows of an interlaced picture, both scaled to bytes but not cut.

    A chroma row takes three columns of its own field's near row and, with a third of the weight, of the far
    one; beyond the edges the last pixel counts."""
    p = _planes(pixels)
    # fixed values: weights in sixteenths of columns -1 to 1, of the near and the far row
    taps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(far).alias("far"), F.lit(w / 16.0).alias("w")) for far, ws in ((False, (3, 6, 3)), (True, (1, 2, 1))) for dx, w in zip((-1, 0, 1), ws, strict=True)]))
    odd = F.pmod(F.col("cy"), F.lit(2)) == 1
    down = F.when(F.col("t.far"), F.when(odd, -1).otherwise(2)).otherwise(F.when(odd, 1).otherwise(0))
    held = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most - 1), c))
    want = p.select("frame").distinct().withColumn("cy", F.explode(F.sequence(F.lit(0), F.lit(height // 2 - 1)))).withColumn("cx", F.explode(F.sequence(F.lit(0), F.lit(width // 2 - 1)))).withColumn("t", taps)
    want = want.select("frame", "cy", "cx", F.col("t.w").alias("w"), held(2 * F.col("cy") + down, height).cast("long").alias("y"), held(2 * F.col("cx") + F.col("t.dx"), width).cast("long").alias("x"))
    c = want.join(p.select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "cb", "cr"), PIXEL)
    total = lambda v: (F.sum(F.col(v) * F.col("w")) * 224 + 128).alias(v)
    chroma = c.groupBy("frame", F.col("cy").alias("y"), F.col("cx").alias("x")).agg(total("cb"), total("cr"))
    return p.select(*PIXEL, (F.col("luma") * 219 + 16).alias("luma")), chroma
