"""A stored composite that follows changes: only the bins of frames that a change touches are computed again.

    path/data/gen=3/bin=17/...      frames that the third refresh computed
    path/bins/gen=3/...             the bins that it covers, those without frames as well

A bin's frames are those of its last refresh. A refresh writes its frames first and its list of bins last, under a number
that its caller gives, so a refresh that is broken off has no effect and one that is run again replaces itself; as the sink
of a stream the number is that of the micro-batch, and every change takes effect once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.graph import fresh


def dirty_bins(changes: DataFrame, width: int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(bin, lo, hi) of the bins that changes [lo, hi) touch, each once, with the frames that a bin has."""
    d = changes.where(F.col(lo) < F.col(hi)).select(F.floor(F.col(lo) / width).cast("long").alias("a"), F.floor((F.col(hi) - 1) / width).cast("long").alias("b")).distinct()
    d = d.select(F.explode(F.sequence("a", "b")).alias("bin")).distinct()
    return d.select("bin", (F.col("bin") * width).alias("lo"), ((F.col("bin") + 1) * width).alias("hi"))


def refresh(changes: DataFrame, path: str, compose: Callable[[DataFrame], DataFrame], gen: int, width: int, frame: str = "frame") -> None:
    """Computes the bins that changes (lo, hi) touch. compose(ranges) gives the frames of ranges (bin, lo, hi), whose frames
    are lo to hi - 1; what it makes beyond them is left out."""
    ranges = fresh(dirty_bins(changes, width))
    if ranges.isEmpty():
        return
    made = compose(ranges).withColumn("bin", F.floor(F.col(frame) / width).cast("long")).join(ranges.select("bin"), "bin", "left_semi")
    made.repartition("bin").sortWithinPartitions("bin", frame).write.mode("overwrite").partitionBy("bin").parquet(f"{path}/data/gen={gen}")
    ranges.select("bin").coalesce(1).write.mode("overwrite").parquet(f"{path}/bins/gen={gen}")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The composite as of the last refresh."""
    bins = spark.read.parquet(f"{path}/bins")
    last = bins.groupBy("bin").agg(F.max("gen").alias("gen"))
    data = spark.read.parquet(f"{path}/data")
    return data.join(last, ["bin", "gen"], "left_semi").drop("bin", "gen")


def follow(changes: DataFrame, path: str, compose: Callable[[DataFrame], DataFrame], width: int, first: int = 1) -> DataStreamWriter:
    """The writer of a stream of changes (lo, hi), which keeps the composite at path; `first` is the first batch's number."""
    return changes.writeStream.foreachBatch(lambda df, k: refresh(df, path, compose, first + k, width))


def changed(before: DataFrame, after: DataFrame, id: str, x: str = "x", length: str = "length") -> DataFrame:
    """The ranges (lo, hi) that edits from one state of items to the next touch: where an item was and where it is,
    if any of its values differ. Values are compared as rows, nulls as equal."""
    own = lambda df, n: df.select(F.col(id).alias("_id"), F.struct(*df.columns).alias(n))
    d = own(before, "_a").join(own(after, "_b"), "_id", "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    both = [d.select(F.col(f"{s}.{x}").alias("lo"), (F.col(f"{s}.{x}") + F.col(f"{s}.{length}")).alias("hi")) for s in ("_a", "_b")]
    return both[0].unionByName(both[1]).where("lo < hi").distinct()


def mixed(items: DataFrame, ranges: DataFrame, value: str = "v", x: str = "x", length: str = "length") -> DataFrame:
    """(frame, value): the sum of all items over each frame of ranges (bin, lo, hi), from the items that lie in them alone."""
    from ..operators import intervals

    r = ranges.select(F.col("lo").alias("_lo"), (F.col("hi") - F.col("lo")).alias("_n"))
    met = intervals.overlap_join(items.select(F.col(x).alias("_x"), F.col(length).alias("_l"), value), r, "_x", "_l", "_lo", "_n")
    met = met.withColumn("frame", F.explode(F.sequence(F.greatest("_x", "_lo"), F.least(F.col("_x") + F.col("_l"), F.col("_lo") + F.col("_n")) - 1)))
    return met.groupBy("frame").agg(F.sum(value).alias(value))
