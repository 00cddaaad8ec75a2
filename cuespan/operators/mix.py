"""Mixing and compositing of layers that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def additive(df: DataFrame, index: list[str], value: str) -> DataFrame:
    """The sum at each index; summed before the shuffle as well."""
    return df.groupBy(*index).agg(F.sum(value).alias(value))


def over(df: DataFrame, index: list[str], order: list[str], colours: list[str], alpha: str) -> DataFrame:
    """Layers laid over each other from the lowest to the highest order; alpha isn't premultiplied.

    A layer's weight is its alpha times what all above let through. Laying over is associative: ranges of the
    order are laid over by themselves, then the ranges of each index over each other, so that an index with a
    large share of all layers is the work of many tasks. Where the result's alpha is 0 everything is.
    """
    by = [*order, *colours, alpha]

    def above(through: Column, keys: list[str], by: list[str]) -> Column:
        w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in by]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.product(through).over(w), F.lit(1.0))

    run = [*index, "_run"]
    rows = df.select(*index, *by).repartitionByRange(*index, *by).withColumn("_run", F.spark_partition_id())
    rows = rows.withColumn("_above", above(1 - F.col(alpha), run, by))
    weight = F.col(alpha) * F.col("_above")
    rows = rows.groupBy(*run).agg(F.product(1 - F.col(alpha)).alias("_through"), *[F.sum(F.col(c) * weight).alias(c) for c in colours])
    rows = rows.withColumn("_above", above(F.col("_through"), index, ["_run"]))
    rows = rows.groupBy(*index).agg((1 - F.product("_through")).alias("_a"), *[F.sum(F.col(c) * F.col("_above")).alias(c) for c in colours])
    return rows.select(*index, *[F.when(F.col("_a") == 0, 0.0).otherwise(F.col(c) / F.col("_a")).alias(c) for c in colours], F.col("_a").alias(alpha))


def crossfade(a: DataFrame, b: DataFrame, index: list[str], value: str, weight: Column) -> DataFrame:
    """a and b aligned by index; an absent side counts as 0, and weight (of b) is held in 0 to 1."""
    both = a.withColumnRenamed(value, "_a").join(b.withColumnRenamed(value, "_b"), index, "full")
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))
    return both.select(*index, (F.coalesce("_a", F.lit(0.0)) * (1 - w) + F.coalesce("_b", F.lit(0.0)) * w).alias(value))


def overwrite(df: DataFrame, index: list[str], value: str, priority: Column) -> DataFrame:
    """The value of highest priority at each index: the last writer."""
    return df.groupBy(*index).agg(F.max_by(value, priority).alias(value))


def bounds(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The range that all results of a key lie in."""
    return df.groupBy(*keys).agg(F.min(start).alias(start), F.max(end).alias(end))


def weave(df: DataFrame, y: str, frame: str, keys: list[str], values: list[str]) -> DataFrame:
    """Even rows from the next frame, odd rows from the own one."""
    w = Window.partitionBy(*keys, y).orderBy(frame)
    return df.withColumns({v: F.when(F.pmod(F.col(y), F.lit(2)) == 0, F.lead(v).over(w)).otherwise(F.col(v)) for v in values})
