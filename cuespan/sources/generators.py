"""Generated sources: empty, a solid colour, a still picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "frame bigint, y int, x int, r double, g double, b double, a double"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PIXELS)


def solid(frames: DataFrame, colour: Column, lo: tuple[int, int], hi: tuple[int, int], window: Column | None = None) -> DataFrame:
    """A colour (array of four, perhaps of the frame) at each pixel of the request that lies in window."""
    p = frames.select("frame", colour.alias("c"), *([window.alias("w")] if window is not None else []))
    p = p.withColumn("y", F.explode(F.sequence(F.lit(lo[1]), F.lit(hi[1])))).withColumn("x", F.explode(F.sequence(F.lit(lo[0]), F.lit(hi[0]))))
    if window is not None:
        p = p.where("x between w.min_x and w.max_x and y between w.min_y and w.max_y")
    return p.select("frame", "y", "x", *[F.col("c")[k].alias(n) for k, n in enumerate("rgba")])


def still(frames: DataFrame, picture: DataFrame, lo: tuple[int, int], hi: tuple[int, int]) -> DataFrame:
    """The same picture (y, x, r, g, b, a) for every frame asked for: frames ask for the window's pixels, and
    meet the picture by pixel."""
    own = picture.where(F.col("x").between(lo[0], hi[0]) & F.col("y").between(lo[1], hi[1]))
    p = frames.select("frame").withColumn("y", F.explode(F.sequence(F.lit(lo[1]), F.lit(hi[1])))).withColumn("x", F.explode(F.sequence(F.lit(lo[0]), F.lit(hi[0]))))
    return p.join(own, ["y", "x"]).select("frame", "y", "x", "r", "g", "b", "a")
