"""Edits of a sequence as pure functions of its table, and an invertible log.

A sequence table has seq, idx, length, offset and transition_length. An edit returns the new table; the
log keeps the rows before and after, so that replaying them backwards undoes it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def update(items: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Set columns of the rows that match."""
    return items.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def move(items: DataFrame, where: Column, x: Column, y: Column) -> DataFrame:
    return update(items, where, x=x, y=y)


def insert(items: DataFrame, rows: DataFrame, seq: str = "seq", idx: str = "idx") -> DataFrame:
    """Rows come before those with an equal index; indexes are dense again."""
    both = rows.withColumn("_o", F.lit(0)).unionByName(items.withColumn("_o", F.lit(1)))
    w = Window.partitionBy(seq).orderBy(idx, "_o")
    return both.withColumn(idx, F.row_number().over(w).cast("long") - 1).drop("_o")


def remove(items: DataFrame, gone: Column, seq: str = "seq", idx: str = "idx", length: str = "length", transition: str = "transition_length") -> DataFrame:
    """Rows go; those that stay keep their place in time.

    What was removed before an item, with the transitions on both sides, becomes a gap before it: the
    next transition is made smaller by the time that went. The first item left starts a new sequence."""
    w = Window.partitionBy(seq).orderBy(idx)
    df = items.withColumn("_gone", gone)
    t = F.when(F.row_number().over(w) == 1, 0).otherwise(F.col(transition))
    before = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("_t", t).withColumn("_len", before).withColumn("_start", F.col("_len") - F.sum("_t").over(w))
    df = df.where(~F.col("_gone"))
    end = F.lag(F.col("_start") + F.col(length)).over(w)
    df = df.withColumn("_end", end).withColumn(transition, F.when(F.col("_end").isNull(), 0).otherwise(F.col("_end") - F.col("_start")))
    return df.withColumn(idx, F.row_number().over(w).cast("long") - 1).drop("_gone", "_t", "_len", "_start", "_end")


def set_length(items: DataFrame, where: Column, by: Column, length: str = "length", seq: str = "seq", idx: str = "idx", transition: str = "transition_length") -> DataFrame:
    """Lengths change; the neighbours' times don't, as the next transition takes the change up."""
    change = F.when(where, F.greatest(by, 1 - F.col(length))).otherwise(0)
    w = Window.partitionBy(seq).orderBy(idx)
    df = items.withColumn("_by", change).withColumn("_prev", F.coalesce(F.lag("_by").over(w), F.lit(0)))
    return df.withColumns({length: F.col(length) + F.col("_by"), transition: F.col(transition) + F.col("_prev")}).drop("_by", "_prev")


def slip(items: DataFrame, where: Column, by: Column, offset: str = "offset") -> DataFrame:
    """Show another part of the source at the same place."""
    return update(items, where, **{offset: F.col(offset) + by})


def move_in_place(items: DataFrame, where: Column, by: Column, seq: str = "seq", idx: str = "idx", transition: str = "transition_length") -> DataFrame:
    """An item moves in time, the others stay: its transition shrinks and the next one grows."""
    w = Window.partitionBy(seq).orderBy(idx)
    df = items.withColumn("_by", F.when(where, by).otherwise(0)).withColumn("_prev", F.coalesce(F.lag("_by").over(w), F.lit(0)))
    return df.withColumn(transition, F.col(transition) - F.col("_by") + F.col("_prev")).drop("_by", "_prev")


def restack(items: DataFrame, moved: Column, part: list[str], back: bool = False, z: str = "z") -> DataFrame:
    """The marked item of each part goes in front of the nearest one before it that overlaps it (the greatest
    lower z), or with back behind the nearest one behind; those between move up by one.

    Items are boxes (x, length, y, height) with dense z in their part. Where nothing overlaps, nothing changes.
    A part's one moved item meets the part's others in an equi-join."""
    box = ["x", "length", "y", "height", z]
    own = items.where(moved).select(*part, *[F.col(c).alias(f"_{c}") for c in box])
    j = items.join(own, part)
    over = (F.col("x") < F.col("_x") + F.col("_length")) & (F.col("_x") < F.col("x") + F.col("length")) & (F.col("y") < F.col("_y") + F.col("_height")) & (F.col("_y") < F.col("y") + F.col("height"))
    beyond = F.col(z) > F.col(f"_{z}") if back else F.col(z) < F.col(f"_{z}")
    to = j.where(over & beyond).groupBy(*part).agg(F.first(f"_{z}").alias("_from"), (F.min(z) if back else F.max(z)).alias("_to"))
    d = items.join(to, part, "left")
    step = F.when(F.col(z) == F.col("_from"), F.col("_to")).when(F.col(z).between(F.least("_from", "_to"), F.greatest("_from", "_to")), F.col(z) + (-1 if back else 1)).otherwise(F.col(z))
    return d.withColumn(z, step).select(*items.columns)


def splice(items: DataFrame, start: int, stop: int, rows: DataFrame, seq: str = "seq", idx: str = "idx") -> DataFrame:
    """Rows take the place of the items [start, stop) of their sequence; indexes are dense again. Other sequences stay."""
    there = rows.select(seq).distinct().withColumn("_cut", F.lit(True))
    w = Window.partitionBy(seq).orderBy(idx)
    new = rows.withColumn("_r", F.row_number().over(w) - 1).withColumns({"_o": F.struct(F.lit(start).cast("long").alias("i"), F.lit(0).alias("k"), F.col("_r").cast("long").alias("r"))}).drop("_r")
    old = items.join(there, seq, "left").where(F.col("_cut").isNull() | (F.col(idx) < start) | (F.col(idx) >= stop)).drop("_cut")
    old = old.withColumn("_o", F.struct(F.col(idx).cast("long").alias("i"), F.lit(1).alias("k"), F.lit(0).cast("long").alias("r"))).select(*new.columns)
    return new.unionByName(old).withColumn(idx, F.row_number().over(Window.partitionBy(seq).orderBy("_o")).cast("long") - 1).drop("_o")


def free_slots(items: DataFrame, seq: str, idx: str, x: str, length: str, need: int) -> DataFrame:
    """Gaps between items that an item of length `need` fits: (seq, before idx, from, to)."""
    w = Window.partitionBy(seq).orderBy(idx)
    end = F.coalesce(F.lag(F.col(x) + F.col(length)).over(w), F.lit(0))
    df = items.withColumn("lo", end).withColumn("hi", F.col(x))
    return df.where(F.col("hi") - F.col("lo") >= need).select(seq, idx, "lo", (F.col("hi") - need).alias("hi"))


def log(before: DataFrame, after: DataFrame, key: list[str], step: int) -> DataFrame:
    """One row for each key that changed: step, before and after (null where there was or is no row)."""
    cols = [c for c in before.columns if c not in key]
    a = before.select(*key, F.struct(*cols).alias("before"))
    b = after.select(*key, F.struct(*cols).alias("after"))
    return a.join(b, key, "full").where(~F.col("before").eqNullSafe(F.col("after"))).select(F.lit(step).alias("step"), *key, "before", "after")


def replay(table: DataFrame, entries: DataFrame, key: list[str], undo: bool = False) -> DataFrame:
    """The table with one step's log applied, or with undo taken back."""
    side = "before" if undo else "after"
    left = table.join(entries.select(*key), key, "left_anti")
    return left.unionByName(entries.where(F.col(side).isNotNull()).select(*key, f"{side}.*"))


def replay_all(table: DataFrame, entries: DataFrame, key: list[str], undo: bool = False) -> DataFrame:
    """The table with a log of many steps applied, or with undo taken back: of each key only its last or first row counts."""
    side = F.min_by("before", "step") if undo else F.max_by("after", "step")
    return replay(table, entries.groupBy(*key).agg(side.alias("before" if undo else "after")), key, undo)


def runs(steps: DataFrame, part: list[str] = ()) -> DataFrame:
    """steps (step, kind, merges) with `run`: a step that merges belongs to the run of the one before it, if that is of
    its kind and merges as well. The run is named by its first step."""
    w = Window.partitionBy(*part).orderBy("step")
    before = F.lag(F.struct("kind", "merges")).over(w)
    first = ~F.coalesce(F.col("merges") & before["merges"] & (before["kind"] == F.col("kind")), F.lit(False))
    return steps.withColumn("_first", F.when(first, F.col("step"))).withColumn("run", F.max("_first").over(w)).drop("_first")


def compact(entries: DataFrame, steps: DataFrame, key: list[str]) -> DataFrame:
    """A log (step, key, before, after) in which the steps of each run of steps (step, run) are one step.

    Of each key the row before the run and the row after it stay; what a run brings and takes away again, or changes
    and changes back, is gone. Replaying the log, and taking it back to where a run began, give what they gave before."""
    d = entries.join(steps.select("step", "run"), "step")
    d = d.groupBy(F.col("run").alias("step"), *key).agg(F.min_by("before", "step").alias("before"), F.max_by("after", "step").alias("after"))
    return d.where(~F.col("before").eqNullSafe(F.col("after"))).select("step", *key, "before", "after")


def compound(table: DataFrame, edits: list) -> DataFrame:
    """Edits (functions of a table) one after the other."""
    return reduce(lambda t, f: f(t), edits, table)


def dirty(old: DataFrame, new: DataFrame, key: list[str], x: str = "x", length: str = "length") -> DataFrame:
    """The range (lo, hi), ends counted, that a change of each key's item touches: the union of old and new."""
    a = old.select(*key, F.col(x).alias("_x0"), F.col(length).alias("_l0"))
    b = new.select(*key, F.col(x).alias("_x1"), F.col(length).alias("_l1"))
    d = a.join(b, key, "full").where(~(F.col("_x0").eqNullSafe(F.col("_x1")) & F.col("_l0").eqNullSafe(F.col("_l1"))))
    return d.select(*key, F.least("_x0", "_x1").alias("lo"), (F.greatest(F.col("_x0") + F.col("_l0"), F.col("_x1") + F.col("_l1")) - 1).alias("hi"))
