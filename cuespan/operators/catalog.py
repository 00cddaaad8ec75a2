"""Names to assets, streams and codecs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecode import frame_time


def resolve(items: DataFrame, assets: DataFrame, path: str, offline: Column | None = None) -> DataFrame:
    """items with their asset's columns and `alert`: null where the name resolves."""
    known = assets.withColumn("_found", F.lit(True))
    out = items.join(known, path, "left")
    alert = F.when(F.col(path).isNull(), "no reference").when(F.col("_found").isNull(), "missing")
    alert = alert.when(offline, "offline") if offline is not None else alert
    return out.withColumn("alert", alert).drop("_found")


def choose(candidates: DataFrame, part: list[str], priority: str, urn: str) -> DataFrame:
    """The candidate of the highest priority, of equal ones that with the greatest name."""
    w = Window.partitionBy(*part).orderBy(F.desc(priority), F.desc(urn))
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def by_urn(wanted: DataFrame, known: DataFrame, urn: str = "urn") -> DataFrame:
    """wanted with what is known under exactly its name; null where nothing is."""
    return wanted.join(known, urn, "left")


def connect(wanted: DataFrame, codecs: DataFrame, key: str) -> DataFrame:
    """wanted (key, format, urn or null) with `codec`: the one of exactly that name if one is asked for, else
    that of the highest priority for the format. codecs: rows (format, urn, priority)."""
    best = choose(codecs, ["format"], "priority", "urn").select("format", F.col("urn").alias("_best"))
    named = codecs.select("urn", F.col("urn").alias("_named")).distinct()
    out = wanted.join(named, "urn", "left").join(best, "format", "left")
    return out.select(key, "format", "urn", F.when(F.col("urn").isNotNull(), F.col("_named")).otherwise(F.col("_best")).alias("codec"))


def alerts_by_root(tree: DataFrame, alerts: DataFrame, root: str = "origin", node: str = "node") -> DataFrame:
    """Alerts of all a root reaches, gathered; a root's own sources bound their number."""
    return tree.join(alerts, node).groupBy(root).agg(F.sort_array(F.collect_set("message")).alias("messages"))


def upsert(assets: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """Rows replace those of the same name."""
    return assets.join(rows.select(path), path, "left_anti").unionByName(rows)


def drop_clip(streams: DataFrame, x: int, default_length: int, rates: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Clips of a dropped asset's streams: each starts at its range's start, open ranges get a default
    length, and later streams are tied both ways to the first, by `offset_ns` if rates (n, d by kind) are given."""
    w = Window.partitionBy("asset_path").orderBy("stream_no")
    lo = F.coalesce("range_min", F.lit(0))
    s = streams.withColumns({"x": F.lit(x) + lo, "offset": lo, "length": F.coalesce(F.col("range_max") - lo + 1, F.lit(default_length))})
    later = F.row_number().over(w) > 1
    s = s.withColumns({"anchor_to": F.when(later, F.first("stream_no").over(w)), "two_way": later})
    if rates is None:
        return s
    ns = reduce(lambda c, r: c.when(F.col("kind") == r[0], frame_time(F.col("x"), *r[1])), rates.items(), F.when(F.lit(False), F.lit(None).cast("long")))
    return s.withColumn("_ns", ns).withColumn("offset_ns", F.when(F.col("two_way"), F.col("_ns") - F.first("_ns").over(w))).drop("_ns")
