"""Sequences of items that follow, overlap or leave gaps; every window is within one sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(seq: list[str], idx: str):
    return Window.partitionBy(*seq).orderBy(idx)


def starts(df: DataFrame, seq: list[str], idx: str, length: str) -> DataFrame:
    """With `start`: the sum of the lengths before."""
    w = _w(seq, idx).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))


def overlap_starts(df: DataFrame, seq: list[str], idx: str, length: str, transition: str) -> DataFrame:
    """With `start`: lengths before less transitions up to here; the first item is at 0, its transition apart."""
    w = _w(seq, idx)
    before = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.when(F.row_number().over(w) == 1, 0).otherwise(F.col(transition))
    out = df.withColumn("_t", own)
    return out.withColumn("start", (before - F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("long")).drop("_t")


def render_plan(df: DataFrame, seq: list[str], idx: str, length: str, transition: str, offset: str) -> DataFrame:
    """How each element is rendered: its own region (region_start, region_length), the place `mid` in it
    where the next item begins to fade in, and where it (a_offset) and the next one (b_offset) are read."""
    out = overlap_starts(df, seq, idx, length, transition)
    w = _w(seq, idx)
    t, next_t = F.when(F.row_number().over(w) == 1, 0).otherwise(F.col(transition)), F.coalesce(F.lead(transition).over(w), F.lit(0))
    out = out.withColumns({"_t": t, "_n": next_t, "_o": F.lead(offset).over(w)})
    size = F.col(length) - F.col("_t")
    mid = size - F.greatest(F.lit(0), F.col("_n"))
    return out.select(
        *df.columns, "start", (F.col("start") + F.col("_t")).alias("region_start"), size.alias("region_length"), mid.alias("mid"),
        (F.col(offset) + F.greatest(F.lit(0), F.col("_t")) + F.least(F.lit(0), F.col("_t"))).alias("a_offset"), F.when(F.col("_n") > 0, F.col("_o") - mid).alias("b_offset"),
    )


def total_length(df: DataFrame, seq: list[str], idx: str, length: str, transition: str) -> DataFrame:
    """A sequence's length: lengths less all transitions but the first."""
    first = F.min_by(transition, idx)
    return df.groupBy(*seq).agg((F.sum(F.col(length) - F.col(transition)) + first).cast("long").alias("length"))


def neighbours(df: DataFrame, seq: list[str], idx: str, value: str, skip: Column) -> DataFrame:
    """With the value of the nearest item before and after that isn't skipped."""
    v = F.when(~skip, F.col(value))
    rising, falling = (Window.partitionBy(*seq).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc(idx), F.desc(idx)))
    return df.withColumns({"previous": F.last(v, True).over(rising), "next": F.last(v, True).over(falling)})


def islands(df: DataFrame, seq: list[str], idx: str) -> DataFrame:
    """With `island`: equal for items whose index follows on."""
    return df.withColumn("island", (F.col(idx) - F.row_number().over(_w(seq, idx))).cast("long"))


def overlap_groups(df: DataFrame, seq: list[str], idx: str, transition: str) -> DataFrame:
    """With `group_no`: a new group where an item doesn't overlap the one before."""
    w = _w(seq, idx)
    new = F.when((F.row_number().over(w) == 1) | (F.col(transition) <= 0), 1).otherwise(0)
    out = df.withColumn("_new", new)
    return out.withColumn("group_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def concat(parts: list[tuple[DataFrame, int, int]], frame: str) -> DataFrame:
    """Sources one after the other, of each `length` frames from `offset`, on one time line."""
    out, at = None, 0
    for df, offset, length in parts:
        own = df.where((F.col(frame) >= offset) & (F.col(frame) < offset + length)).withColumn(frame, F.col(frame) - offset + at)
        out, at = own if out is None else out.unionByName(own), at + length
    return out


def rerank(df: DataFrame, part: list[str], order: list, to: str = "z") -> DataFrame:
    """Dense positions from 0 after items came or went."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("long") - 1)


def merge(streams: list[DataFrame], time: str, tie: list[str] = (), keys: list[str] = ()) -> DataFrame:
    """Packets of all streams with their stream number, in order of time, stream and then tie: one global
    sort, or with keys the place `pos` from 1 within each."""
    out = None
    for k, s in enumerate(streams):
        s = s.withColumn("stream", F.lit(k))
        out = s if out is None else out.unionByName(s)
    order = [time, "stream", *tie]
    return out.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")) if keys else out.orderBy(*order)


def positions(items: DataFrame, part: list[str], right: bool = False, id: str = "item_id") -> DataFrame:
    """With `pos` from 0: items of each part by (x, z, id), or by their right edge and z, the last ones first."""
    order = [F.desc(F.col("x") + F.col("length")), F.desc("z"), F.desc(id)] if right else [F.asc("x"), F.asc("z"), F.asc(id)]
    return items.withColumn("pos", F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("long") - 1)


def paint_order(items: DataFrame, part: list[str], id: str = "item_id") -> DataFrame:
    """With `paint` from 0: the lowest item first, of one height the hindmost, which has the greatest z."""
    return items.withColumn("paint", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("y"), F.desc("z"), F.asc(id))).cast("long") - 1)


def at(df: DataFrame, pos: str, lo: int, hi: int | None = None) -> DataFrame:
    """The row at a position, or with hi the slice [lo, hi)."""
    return df.where(F.col(pos) == lo) if hi is None else df.where((F.col(pos) >= lo) & (F.col(pos) < hi))


def find(df: DataFrame, key: str, lo=None, hi=None) -> DataFrame:
    """Rows with lo <= key <= hi, in order."""
    df = df.where(F.col(key) >= lo) if lo is not None else df
    df = df.where(F.col(key) <= hi) if hi is not None else df
    return df.orderBy(key)


def nearest(df: DataFrame, keys: list[str], edge: str, at: Column, within: float) -> DataFrame:
    """The edge nearest to a place, if it lies within a distance; the lower one of two."""
    d = F.abs(F.col(edge) - at)
    return df.where(d < within).groupBy(*keys).agg(F.min_by(edge, F.struct(d, F.col(edge))).alias(edge))


def keyed_edits(items: DataFrame, edits: DataFrame, part: list[str], id: str, key: str, pos: str = "pos") -> DataFrame:
    """Sorted lists, one for each part, after edits (part, step, op, id, key): `add`, `remove` or `move` of one item by its key.

    What is added, or moved to a new key, comes before all of an equal key; others keep their order. So the last edit
    of an item decides where it stands: by key, then the latest edit first, then the place that it had. What is added
    in one step has no order of steps or places; it stands by id."""
    last = edits.groupBy(*part, id).agg(F.max("step").alias("_step"), F.max_by("op", "step").alias("_op"), F.max_by(key, "step").alias("_new"))
    d = items.join(last, [*part, id], "full").where("_op is null or _op <> 'remove'")
    d = d.withColumns({key: F.when(F.col("_op").isNotNull(), F.col("_new")).otherwise(F.col(key)), "_age": F.coalesce("_step", F.lit(-1))})
    w = Window.partitionBy(*part).orderBy(key, F.desc("_age"), pos, id)
    return d.withColumn(pos, F.row_number().over(w).cast("long") - 1).select(*items.columns)


def workspace_edits(items: DataFrame, edits: DataFrame, id: str = "item_id") -> DataFrame:
    """items after edits (step, op, id, and the items' other columns): `add` gives all columns, `update` those that are not
    null, `remove` takes an item away. Each item's edits count from its last `add` or `remove` on."""
    cols = [c for c in items.columns if c != id]
    w = Window.partitionBy(id)
    d = edits.withColumn("_from", F.max(F.when(F.col("op") != "update", F.col("step"))).over(w)).where("_from is null or step >= _from")
    given = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("step"))).alias(f"_{c}") for c in cols]
    d = d.groupBy(id).agg(F.min_by("op", "step").alias("_op"), *given)
    out = items.join(d, id, "full").where("_op is null or _op <> 'remove'")
    kept = {c: F.when(F.col("_op") == "add", F.col(f"_{c}")).otherwise(F.coalesce(f"_{c}", c)) for c in cols}
    # an update of an item that isn't there has no effect
    there = items.select(id, F.lit(True).alias("_old"))
    out = out.join(there, id, "left").where("_old or _op = 'add'")
    return out.withColumns({c: v.cast(items.schema[c].dataType) for c, v in kept.items()}).select(*items.columns)
