"""Shift, trim, scale, copy and fill of indexed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecode import varispeed_index


def shift_window(df: DataFrame, frame: str, offset: int = 0, start: int | None = None, end: int | None = None) -> DataFrame:
    """out[f] = in[f + offset] for start <= f < end, in output frames; the filter reaches the scan."""
    out = df.withColumn(frame, F.col(frame) - offset)
    out = out.where(F.col(frame) >= start) if start is not None else out
    return out.where(F.col(frame) < end) if end is not None else out


def window_2d(df: DataFrame, x: str, y: str, lo: tuple[int, int], hi: tuple[int, int]) -> DataFrame:
    """Rows inside a box that counts both ends: a fetch of one window, and a crop."""
    return df.where(F.col(x).between(lo[0], hi[0]) & F.col(y).between(lo[1], hi[1]))


def fetch_samples(df: DataFrame, sample: str, channel: str, value: str, lo: int, hi: int, channels: int) -> DataFrame:
    """Samples lo to hi of channels 0 to channels - 1; missing ones are silent, surplus channels go."""
    spark = df.sparkSession
    spine = spark.range(lo, hi + 1).withColumnRenamed("id", sample).withColumn(channel, F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    own = df.where(F.col(sample).between(lo, hi) & (F.col(channel) < channels))
    return spine.join(own, [sample, channel], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def gain_offset(c: Column, gain: float = 1.0, offset: float = 0.0) -> Column:
    return c * F.lit(float(gain)) + F.lit(float(offset))


def attenuate(df: DataFrame, sample: str, value: str, factor: float, offset: int = 0) -> DataFrame:
    """out[s] = in[s + offset] * factor; a factor of 0 gives no rows."""
    out = df.withColumns({sample: F.col(sample) - offset, value: F.col(value) * F.lit(float(factor))})
    return out if factor else out.limit(0)


def copy_alpha(df: DataFrame, alpha: Column, a: str = "a") -> DataFrame:
    """Only the alpha channel is scaled, by alpha held in 0 to 1."""
    return df.withColumn(a, F.col(a) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha)))


#: Frames that one row of fill() stands for until they are made.
FILL = 4096


def every(df: DataFrame, frame: str, k: int) -> DataFrame:
    """Every k-th frame."""
    return df.where(F.pmod(F.col(frame), F.lit(k)) == 0)


def frames(spans: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """(keys, frame) for each frame of spans (keys, lo, hi), ends counted, block by block."""
    at = lambda c: F.floor(F.col(c) / F.lit(FILL)).cast("long")
    edge = lambda c: F.col(c).cast("long")
    d = spans.where("lo <= hi").withColumn("_block", F.explode(F.sequence(at("lo"), at("hi")))).repartition(*keys, "_block")
    own = F.sequence(F.greatest(edge("lo"), F.col("_block") * FILL), F.least(edge("hi"), (F.col("_block") + 1) * FILL - 1))
    return d.select(*keys, F.explode(own).alias(frame))


def varispeed(df: DataFrame, keys: list[str], sample: str, value: str, start: int, count: int, n: int, d: int, empty=0.0) -> DataFrame:
    """`count` output samples from 0 of each key, read from `start` on at speed n / d by the nearest sample before; at a
    negative speed the last output is what is read first. Samples that the key doesn't have are `empty`."""
    spine = frames(df.select(*keys).distinct().withColumns({"lo": F.lit(0), "hi": F.lit(count - 1)}), keys, "_out")
    i = F.col("_out") if n > 0 else F.lit(count - 1) - F.col("_out")
    spine = spine.withColumn("_at", F.lit(start) + varispeed_index(i, F.lit(n), F.lit(d)))
    own = df.select(*keys, F.col(sample).cast("long").alias("_at"), value)
    out = spine.join(own, [*keys, "_at"], "left")
    return out.select(*keys, F.col("_out").alias(sample), F.coalesce(value, F.lit(empty)).alias(value))


def fill(df: DataFrame, frame: str, value: str, keys: list[str] = (), empty=0.0) -> DataFrame:
    """A row for each whole frame between the first and last of each key; missing values are `empty`.

    Frames are made block by block, each block where it is dealt to, so that no row or task holds a key's whole range."""
    keys = list(keys)
    spine = df.groupBy(*keys).agg(F.min(frame).alias("lo"), F.max(frame).alias("hi")).where("lo is not null")
    spine = frames(spine, keys, frame).withColumn(frame, F.col(frame).cast(df.schema[frame].dataType))
    return spine.join(df, [*keys, frame], "left").withColumn(value, F.coalesce(value, F.lit(empty)))


def first_of_type(df: DataFrame, part: list[str], order: list) -> DataFrame:
    """The first row of each part: default streams, and the codec of highest priority."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def property_of(override: Column, detected: Column, key: str, default: str | None = None) -> Column:
    """Overridden before detected metadata."""
    return F.coalesce(F.try_element_at(override, F.lit(key)), F.try_element_at(detected, F.lit(key)), F.lit(default))
