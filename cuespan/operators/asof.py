"""As-of lookups of keyframes and their interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOLD, LINEAR = 0, 1


def bracket(frames: DataFrame, keyframes: DataFrame, at: str, frame: str, value: str, kind: str, keys: list[str]) -> DataFrame:
    """frames with the keyframe at or before them (left_*) and the one after (right_*), null where there is none.

    Both sides meet sorted by key and place; there is no pair of rows to compare. Rows of frames may repeat.
    A key's rows are one task's work, so a table without keys is read in one.
    """
    row = F.struct(*[F.col(c) for c in frames.columns])
    many = keyframes.schema[value].dataType.typeName() == "array"
    held = "array<double>" if many else "double"
    f = frames.select(*keys, F.col(at).cast("double").alias("_at"), F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).cast(f"struct<f:double,v:{held},k:int>").alias("_key"))
    k = keyframes.select(*keys, F.col(frame).cast("double").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(f.schema["_row"].dataType).alias("_row"), F.struct(F.col(frame).cast("double").alias("f"), F.col(value).cast(held).alias("v"), F.col(kind).cast("int").alias("k")).alias("_key"))
    both = k.unionByName(f)
    # the last keyframe so far, in rising and in falling order: each is one pass, which keeps one value
    rising, falling = (Window.partitionBy(*keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (("_at", "_side"), (F.desc("_at"), F.desc("_side"))))
    both = both.withColumn("_left", F.last("_key", ignorenulls=True).over(rising))
    both = both.withColumn("_right", F.last("_key", ignorenulls=True).over(falling))
    out = both.where("_side = 1")
    return out.select("_row.*", *[F.col(f"_{s}.{c}").alias(f"{s}_{n}") for s in ("left", "right") for c, n in (("f", "frame"), ("v", "value"), ("k", "kind"))])


def interpolate(frames: DataFrame, keyframes: DataFrame, at: str, frame: str = "frame", value: str = "value", kind: str = "kind", keys: list[str] = ()) -> DataFrame:
    """frames with `interpolated`: the first value before all keyframes, the last one's after them, the left
    one's after a hold, else on the line between both; 0 without any keyframe. A value that is an array has one to four
    parts and is padded with 0 to four; other numbers of parts are an error."""
    if keyframes.schema[value].dataType.typeName() == "array":
        return _four(frames, keyframes, at, frame, value, kind, list(keys))
    b = bracket(frames, keyframes, at, frame, value, kind, list(keys))
    t = (F.col(at) - F.col("left_frame")) / (F.col("right_frame") - F.col("left_frame"))
    v = F.when(F.col("left_frame").isNull(), F.coalesce("right_value", F.lit(0.0))).when(F.col("right_frame").isNull() | (F.col("left_kind") == HOLD), F.col("left_value"))
    return b.withColumn("interpolated", v.otherwise(F.col("left_value") + (F.col("right_value") - F.col("left_value")) * t))


def _four(frames: DataFrame, keyframes: DataFrame, at: str, frame: str, value: str, kind: str, keys: list[str]) -> DataFrame:
    padded = F.concat(F.col(value).cast("array<double>"), F.array_repeat(F.lit(0.0), 4 - F.size(value)))
    ok = F.coalesce(F.size(value).between(1, 4), F.lit(False))
    k = keyframes.withColumn(value, F.when(ok, padded).otherwise(F.raise_error(F.lit("a value has one to four parts"))))
    b = bracket(frames, k, at, frame, value, kind, keys)
    t = (F.col(at) - F.col("left_frame")) / (F.col("right_frame") - F.col("left_frame"))
    v = F.when(F.col("left_frame").isNull(), F.coalesce("right_value", F.array_repeat(F.lit(0.0), 4))).when(F.col("right_frame").isNull() | (F.col("left_kind") == HOLD), F.col("left_value"))
    return b.withColumn("interpolated", v.otherwise(F.zip_with("left_value", "right_value", lambda a, c: a + (c - a) * t)))
