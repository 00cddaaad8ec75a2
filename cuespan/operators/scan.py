"""Segmented scans: running sums and greatest values along an order, in which one key may hold most rows.

A window over a key is one task's work. Here rows are sorted by (keys, order) over all tasks and numbered; each
partition scans its own part of a key, and what the partitions before it hold of that key is added from a
table of one row for each key and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import fresh


def numbered(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """df sorted by keys and order and written, with `_row`, which rises along that order over all partitions."""
    return fresh(df.orderBy(*keys, *order).withColumn("_row", F.monotonically_increasing_id()))


def placed(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with `name`, the places 0, 1, 2 ... of its rows along the order. A row's place in its partition is in its `_row`; what the
    partitions before it hold is a table of one row for each."""
    d = numbered(df, [], order).withColumn("_part", F.shiftright("_row", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = d.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    d = d.join(F.broadcast(held), "_part")
    return d.withColumn(name, F.col("_n") + F.col("_row").bitwiseAND((1 << 33) - 1)).drop("_part", "_row", "_n")


def running(d: DataFrame, keys: list[str], sums: dict[str, Column] = {}, greatest: dict[str, Column] = {}) -> DataFrame:
    """Rows of numbered() with sums over the rows of their key before them, and greatest values with their own row."""
    part = F.shiftright("_row", 33)
    values = {f"_v_{n}": c for n, c in (*sums.items(), *greatest.items())}
    d = d.withColumns({"_part": part, **values})
    held = d.groupBy(*keys, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums], *[F.max(f"_v_{n}").alias(f"_p_{n}") for n in greatest])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = {**{f"_c_{n}": F.coalesce(F.sum(f"_p_{n}").over(before), F.lit(0)) for n in sums}, **{f"_c_{n}": F.max(f"_p_{n}").over(before) for n in greatest}}
    held = held.select(*keys, "_part", *[c.alias(n) for n, c in carried.items()])
    own = Window.partitionBy(*keys, "_part").orderBy("_row")
    past, upto = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({**{n: F.coalesce(F.sum(f"_v_{n}").over(past), F.lit(0)) for n in sums}, **{n: F.max(f"_v_{n}").over(upto) for n in greatest}})
    d = d.join(held, [*keys, "_part"])
    d = d.withColumns({**{n: F.col(n) + F.col(f"_c_{n}") for n in sums}, **{n: F.greatest(n, f"_c_{n}") for n in greatest}})
    return d.drop("_part", *values, *[f"_c_{n}" for n in (*sums, *greatest)])


def first_at_least(d: DataFrame, keys: list[str], value: str, pos: str, least: Column, width: int) -> DataFrame:
    """(keys, pos, first): for each row the first place of its key where value, which never falls along pos, is at least
    its own `least`; null where there is none. Bins of `width` keep each search among few rows."""
    at = lambda v: F.floor(v / F.lit(width)).cast("long")
    rows = d.select(*keys, at(F.col(value)).alias("_bin"), F.col(value).alias("_at"), F.col(pos).alias("_first"), F.lit(None).cast("long").alias("_asks"))
    asks = d.select(*keys, at(least).alias("_bin"), least.alias("_at"), F.lit(None).cast("long").alias("_first"), F.col(pos).alias("_asks"))
    both = rows.unionByName(asks)
    # in a bin: of the rows that are no less, which come first here, the first place
    w = Window.partitionBy(*keys, "_bin").orderBy(F.desc("_at"), F.asc_nulls_last("_first")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_in", F.min("_first").over(w)).where("_asks is not null")
    bins = both.groupBy(*keys, "_bin").agg(F.min("_first").alias("_first"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "_bin", F.min("_first").over(later).alias("_next"))
    return found.join(bins, [*keys, "_bin"]).select(*keys, F.col("_asks").alias(pos), F.coalesce("_in", "_next").alias("first"))
