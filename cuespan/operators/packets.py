"""Packets: time stamps, seeking, sample positions, blocks and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import scan
from .graph import fresh


def demux(packets: DataFrame, stream: int, n: int, d: int) -> DataFrame:
    """One stream's packets; a missing pts is the dts; stamps go to frames, halves up."""
    up = lambda c: F.call_function("div", F.col(c) * d + n // 2, F.lit(n))
    p = packets.where(F.col("stream_id") == stream).withColumn("pts", F.coalesce("pts", "dts"))
    return p.withColumns({"pts": up("pts"), "dts": up("dts")})


def seek(packets: DataFrame, frame: int, keys: list[str] = ()) -> DataFrame:
    """Packets from the last keyframe at or before a frame."""
    key = packets.where(F.col("keyframe") & (F.col("pts") <= frame))
    if not keys:
        first = key.agg(F.max(F.struct("pts", "seq"))["seq"]).first()[0]  # one number
        return packets.where(F.lit(False) if first is None else F.col("seq") >= first)
    return packets.join(key.groupBy(*keys).agg(F.max(F.struct("pts", "seq"))["seq"].alias("_s")), list(keys)).where("seq >= _s").drop("_s")


def known_starts(packets: DataFrame, table: DataFrame, keys: list[str], stamp: str, sample: str = "sample") -> DataFrame:
    """packets with the sample that the table (keys, stamp, sample) has for exactly their time stamp; their own elsewhere."""
    t = table.groupBy(*keys, stamp).agg(F.min(sample).alias("_known"))
    return packets.join(t, [*keys, stamp], "left").withColumn(sample, F.coalesce("_known", sample)).drop("_known")


def sample_positions(packets: DataFrame, keys: list[str], pts: str, n: str) -> DataFrame:
    """With `sample`: where each packet's samples start, from the durations before it."""
    w = Window.partitionBy(*keys).orderBy(pts).rowsBetween(Window.unboundedPreceding, -1)
    return packets.withColumn("sample", F.coalesce(F.sum(n).over(w), F.lit(0)))


def blocks(df: DataFrame, keys: list[str], sample: str, value: str, lo: Column, hi: Column, size: int = 1024) -> DataFrame:
    """(keys, block, first, samples): samples lo to hi in blocks of `size` from lo on, the last one shorter.

    lo and hi are columns of df, equal in all rows of a key. Absent samples are 0, of equal ones the values are
    added up before blocks are gathered, so a block's list has `size` values however many rows there are."""
    d = df.select(*keys, lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.col(sample).cast("long").alias("_s"), F.col(value).alias("_v"))
    one = d.where("_s between lo and hi").groupBy(*keys, "lo", "_s").agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("_v"))
    own = one.groupBy(*keys, F.call_function("div", F.col("_s") - F.col("lo"), F.lit(size)).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("_s", "_v"))).alias("_m"))
    ranges = d.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <= hi")
    spine = ranges.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("hi") - F.col("lo"), F.lit(size)))))
    spine = spine.withColumns({"first": F.col("lo") + F.col("block") * size, "_last": F.least("hi", F.col("lo") + (F.col("block") + 1) * size - 1)})
    out = spine.join(own, [*keys, "block"], "left")
    at = lambda s: F.coalesce(F.try_element_at("_m", s), F.lit(0.0))
    return out.select(*keys, "block", "first", F.transform(F.sequence("first", "_last"), at).alias("samples"))


def clusters(df: DataFrame, key: str, order: list[str], time: str, size: str, ticks: int = 32767, max_bytes: int = 5 << 20) -> DataFrame:
    """With `cluster` from 0: a new one where a packet is over `ticks` from the cluster's start, or the packets of the
    cluster before it passed max_bytes. Times are whole numbers.

    Wherever a cluster might start, its end follows from that packet alone: the first one whose time, or whose sum of
    bytes before it, passes a bound, found by a search in bins. Starts are what the first packet reaches by those
    links, in steps that double; no task folds a key. That holds as long as no packet is more than `ticks` before an earlier one of its key;
    keys with such a packet are folded row by row."""
    d = scan.numbered(df.withColumn("_time", F.col(time).cast("long")), [key], order)
    d = fresh(scan.running(d, [key], {"_pos": F.lit(1), "_before": F.col(size).cast("long")}, {"_late": F.col("_time")}))
    back = d.where(F.col("_late") - F.col("_time") > ticks).select(key).distinct()
    if not back.isEmpty():
        back = fresh(back)
        odd = _folded(df.join(back, key, "left_semi"), key, order, time, size, ticks, max_bytes)
        return clusters(df.join(back, key, "left_anti"), key, order, time, size, ticks, max_bytes).unionByName(odd)
    p = d.select(F.col(key).alias("_k"), "_pos", "_time", "_before", "_late")
    by_time = scan.first_at_least(p, ["_k"], "_late", "_pos", F.col("_time") + ticks + 1, ticks + 1)
    by_size = scan.first_at_least(p, ["_k"], "_before", "_pos", F.col("_before") + max_bytes + 1, max_bytes + 1)
    ends = by_time.join(by_size.withColumnRenamed("first", "_other"), ["_k", "_pos"]).select("_k", "_pos", F.least("first", "_other").alias("_to"))
    # both in one table, a write a round: known starts, whose _to is null, and links to later ones
    both = fresh(ends.where("_to is not null").unionByName(p.where("_pos = 0").select("_k", "_pos", F.lit(None).cast("long").alias("_to"))))
    while True:
        starts, jump = both.where("_to is null"), both.where("_to is not null")
        if jump.isEmpty():
            break
        led = starts.select("_k", "_pos").join(jump, ["_k", "_pos"]).select("_k", F.col("_to").alias("_pos"), F.lit(None).cast("long").alias("_to"))
        far = jump.join(jump.select("_k", F.col("_pos").alias("_to"), F.col("_to").alias("_far")), ["_k", "_to"]).select("_k", "_pos", F.col("_far").alias("_to"))
        both = fresh(starts.unionByName(led).unionByName(far))
    starts = starts.select(F.col("_k").alias(key), "_pos", F.lit(1).alias("_start"))
    d = d.join(starts, [key, "_pos"], "left").withColumn("_start", F.coalesce("_start", F.lit(0)))
    d = scan.running(d, [key], {"_n": F.col("_start")})
    return d.withColumn("cluster", (F.col("_n") + F.col("_start") - 1).cast("long")).select(*df.columns, "cluster")


def _folded(df: DataFrame, key: str, order: list[str], time: str, size: str, ticks: int, max_bytes: int) -> DataFrame:
    """clusters() by a fold that streams over sorted partitions and holds a few numbers, a task for each key."""
    import pandas as pd

    cols = df.columns
    schema = StructType([*df.schema.fields, StructField("cluster", LongType())])

    def run(parts):
        now, start, held, k = None, 0, 0, -1
        for p in parts:
            out = []
            for who, t, n in zip(p[key], p[time], p[size], strict=True):
                if who != now:
                    now, start, held, k = who, t, 0, 0
                elif abs(t - start) > ticks or held > max_bytes:
                    start, held, k = t, 0, k + 1
                held += n
                out.append(k)
            yield pd.concat([p[cols].reset_index(drop=True), pd.Series(out, name="cluster", dtype="int64")], axis=1)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def cues(clustered: DataFrame, key: str, time: str, keyframe: Column) -> DataFrame:
    """Of clusters() the packets that a player can start from, with the start of their cluster."""
    start = clustered.groupBy(key, "cluster").agg(F.min(time).alias("cluster_start"))
    return clustered.where(keyframe).join(start, [key, "cluster"])
