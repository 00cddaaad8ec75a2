"""Where items fit into sequences, and edits that fail where there is no room.

A sequence table has seq, idx, length, transition_length. A mover is a run of overlapping items that moves
as one: rows of a table with the same columns, seq being where it goes. Every step is a window within a
sequence or a join by sequence; sequences are edited side by side and none waits for another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import overlap_groups, overlap_starts

NO_ROOM = "there is no room for the item"


def guarded(ok: Column, value: Column) -> Column:
    """value where ok holds, else the error that there is no room."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(NO_ROOM)))


def mover_sizes(items: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """keys with `size` and the longest transitions at both ends (fade_in, fade_out) of each run of overlapping items."""
    w = Window.partitionBy(*keys).orderBy(idx)
    d = items.select(*keys, idx, "length", F.when(F.row_number().over(w) == 1, 0).otherwise(F.col("transition_length")).alias("_t"))
    d = d.withColumn("_next", F.lead("_t").over(w))
    return d.groupBy(*keys).agg(
        F.sum(F.col("length") - F.col("_t")).cast("long").alias("size"),
        F.min_by(F.col("length") - F.coalesce("_next", F.lit(0)), idx).cast("long").alias("fade_in"),
        F.max_by(F.col("length") - F.col("_t"), idx).cast("long").alias("fade_out"),
    )


def placements(items: DataFrame, sizes: DataFrame, seq: str = "seq", idx: str = "idx") -> DataFrame:
    """Rows (seq, idx, lo, hi): a mover of sizes (seq, size, fade_in, fade_out) may start at lo to hi before item idx.

    Places count from the sequence's start; a null end is open. There is one index more than items."""
    w = Window.partitionBy(seq).orderBy(idx)
    d = overlap_starts(items, [seq], idx, "length", "transition_length")
    t = F.when(F.col("idx") > 0, F.greatest(F.lit(0), F.col("transition_length"))).otherwise(0)
    d = d.select(
        seq, idx, "length", "start", F.col("transition_length").alias("t"), F.lag(F.col("start") + t).over(w).alias("after"),
        F.coalesce(F.lead("transition_length").over(w), F.lit(0)).alias("next_t"), (F.col("start") + t).alias("own"), F.lead(idx).over(w).isNull().alias("last"),
    ).join(sizes, seq)
    before = F.greatest("after", F.col("start") + F.least(F.lit(0), F.col("t")) - F.col("fade_in"))
    hi = F.col("start") - F.col("size") + F.least(F.col("fade_out"), F.col("length") - F.col("next_t"))
    inner = d.where((F.col(idx) == 0) | (F.col("t") <= 0)).select(seq, F.col(idx).cast("long").alias(idx), F.when(F.col(idx) > 0, before).alias("lo"), hi.alias("hi"))
    end = d.where("last").select(seq, (F.col(idx) + 1).cast("long").alias(idx), F.greatest("own", F.col("start") + F.col("length") - F.col("fade_in")).alias("lo"), F.lit(None).cast("long").alias("hi"))
    return inner.where("lo is null or lo <= hi").unionByName(end)


def where_fits(items: DataFrame, sizes: DataFrame, at: DataFrame, seq: str = "seq", idx: str = "idx") -> DataFrame:
    """at (seq, x) with `at_idx`, the least index at which the mover fits at x; null where there is none."""
    p = placements(items, sizes, seq, idx).join(at.select(seq, "x"), seq).where("(lo is null or x >= lo) and (hi is null or x <= hi)")
    return at.join(p.groupBy(seq).agg(F.min(idx).alias("at_idx")), seq, "left")


def place_all(items: DataFrame, movers: DataFrame, at: DataFrame | None, seq: str = "seq", idx: str = "idx", mover: str = "mover", strict: bool = True, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """items with many movers put in, and rows (seq, shift) by which sequences move.

    movers has the columns of items and `mover`; at (seq, mover, x) says where each begins, counted from the start that its
    sequence has now; without it the movers' rows have `x`. The result is that of putting them in one by one in the order of x.
    Neighbours keep their times; a mover put in first moves the start of its sequence instead. Two movers can't begin at one
    place of a sequence, and with `kind` (a column of both) a mover must be of the kind of its sequence's first item. Where one
    has no room, it is an error, or without strict all of that sequence stays as it is.

    Items never move in time, so an item's transition is where the one before it ends less its own start. Items and movers
    are sorted together; each mover then looks at the element before it and at the item after it, whatever the
    number of movers: two sorts within a sequence, the second for movers that begin where an item does. A mover is one
    element, its first row; its other rows go along behind. No step is a join, and every window is within a sequence,
    so that rows are shuffled by sequence alone, and not again if they come by sequence.
    """
    w = Window.partitionBy(seq).orderBy(idx)
    null = F.lit(None).cast("long")
    long = lambda c: c.cast("long")
    own = overlap_starts(items, [seq], idx, "length", "transition_length")
    own = own.withColumn("_next", F.coalesce(F.lead("transition_length").over(w), F.lit(0)))
    # an item may begin before the one ahead of it does, if that one is shorter than their transition; the order is by index still
    own = own.withColumn("_key", F.max("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # _place: movers (0, or 2 behind an item of the same start) and items (1); _last: where the last row begins; _own: its transition
    # within a mover of several rows; _in, _out: how far it may be overlapped at its ends
    olds = own.select(
        *items.columns, F.lit(1).alias("_place"), "_key", F.col("start").alias("_x"), long(F.col("start") + F.col("length")).alias("_end"), F.col("start").alias("_last"),
        null.alias("_own"), long(F.col("length") - F.col("_next")).alias("_in"), null.alias("_out"),
    )
    # what has no sequence or no place gets no _x and is left out below: a filter here would part the plan from that of the items
    named = lambda x: F.when(F.col(seq).isNotNull() & F.col(mover).isNotNull(), long(x)).alias("_x")
    m = movers.select(*items.columns, F.col(mover).alias("_m"), named(F.col("x") if at is None else null), F.lit(1).alias("_row"))
    if at is not None:
        m = m.unionByName(at.select(seq, F.col(mover).alias("_m"), named(F.col("x")), F.lit(0).alias("_row")), allowMissingColumns=True)
    run = Window.partitionBy(seq, "_m").orderBy("_row", idx)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the others' order, so that a task sorts once
    # counted within the sequence first, so that rows are shuffled by that alone
    m = m.withColumn("_c", F.sum("_row").over(Window.partitionBy(seq).orderBy("_m", "_row", idx).rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("_x", F.max("_x").over(whole)).where("_row = 1 and _x is not null").withColumn("_r", F.col("_c") - F.min("_c").over(whole) + 1)
    m = m.withColumn("_t", F.when(F.col("_r") > 1, F.col("transition_length")).otherwise(0)).withColumn("_size", F.col("length") - F.col("_t"))
    m = m.withColumns({
        "_n": F.count("*").over(whole), "_end": F.col("_x") + F.sum("_size").over(whole), "_ll": F.last("length").over(whole), "_lt": F.last("_t").over(whole),
        "_in": F.col("length") - F.coalesce(F.lead("_t").over(run), F.lit(0)),
    })
    of_first = {"_x": F.col("_x"), "_end": F.col("_end"), "_last": F.col("_end") - F.col("_ll"), "_own": F.when(F.col("_n") > 1, F.col("_lt")), "_in": F.col("_in"), "_out": F.col("_ll") - F.col("_lt")}
    news = m.select(*items.columns, F.lit(0).alias("_place"), F.col("_x").alias("_key"), *[long(F.when(F.col("_r") == 1, v)).alias(c) for c, v in of_first.items()])
    d = olds.unionByName(news)
    item, first = F.col("_place") == 1, (F.col("_place") != 1) & F.col("_x").isNotNull()
    up = Window.partitionBy(seq).orderBy("_key", "_place", idx)
    everything = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def near(value: str, step: int) -> Column:
        """The value so many rows further on, rows without it apart; in the order of `up`."""
        return F.expr(f"{'lead' if step > 0 else 'lag'}({value}, {abs(step)}) ignore nulls over (partition by `{seq}` order by _key, _place, `{idx}`)")

    def looked(d: DataFrame) -> DataFrame:
        """With `_fits`: whether a mover has room between the element before it and the next item."""
        # a plain column first: the sort is below it, and what the others look at is made of sorted rows
        d = d.withColumn("_pp", near("_end", -2))
        d = d.withColumns({"_p": near("if(_x is null, null, struct(_place, _x, _end, _last, _own))", -1), "_after": near("if(_place = 1, struct(_x as x, _in as room), null)", 1)})
        lap = F.greatest(F.lit(0), F.coalesce(F.col("_p._own"), F.col("_pp") - F.col("_p._x"), F.lit(0)))
        left = F.col("_p").isNull() | ((F.col("_x") >= F.col("_p._last") + lap) & (F.col("_x") >= F.col("_p._end") - F.col("_in")))
        free = F.col("_p").isNull() | F.col("_after").isNull() | (F.col("_p._end") <= F.col("_after.x"))
        right = F.col("_after").isNull() | (F.col("_end") <= F.col("_after.x") + F.least("_out", "_after.room"))
        return d.withColumn("_fits", left & free & right)

    # a mover that has no room before an item of the same start is tried behind it, with all its rows
    late = looked(d).withColumns({"_late": F.when(first, ~F.col("_fits") & F.coalesce(F.col("_after.x") == F.col("_x"), F.lit(False))), "_alone": F.when(first, ~F.coalesce((F.col("_p._place") != 1) & (F.col("_p._x") == F.col("_x")), F.lit(False)))})
    late = late.withColumn("_late", F.last("_late", True).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    late = late.withColumn("_place", F.when(~item & F.col("_late"), 2).otherwise(F.col("_place")))
    d = looked(late.drop("_pp", "_p", "_after", "_fits", "_late"))
    ok = F.col("_fits") & F.col("_alone")
    if kind:
        d = d.withColumn("_first", F.first(F.when(item, F.struct(F.col(kind).alias("kind"))), True).over(everything))
        ok = ok & F.col(kind).eqNullSafe(F.col("_first.kind"))
    d = d.withColumns({"_ok": F.coalesce(F.min(F.when(first, ok.cast("int"))).over(everything), F.lit(1)) == 1, "_idx": F.row_number().over(up) - 1})
    d = d.withColumn("_ok", guarded(F.col("_ok"), F.col("_ok"))) if strict else d
    d = d.withColumn("_t", F.when(F.col("_p").isNull(), F.when(first, 0)).otherwise(F.col("_p._end") - F.col("_x")))
    fresh = {idx: F.when(F.col("_ok"), F.col("_idx")).otherwise(F.col(idx)), "transition_length": F.when(F.col("_ok"), F.coalesce("_t", "transition_length")).otherwise(F.col("transition_length"))}
    out = d.where(item | F.col("_ok")).select(*[fresh[c].cast(items.schema[c].dataType).alias(c) if c in fresh else F.col(c) for c in items.columns])
    return out, d.where(first & F.col("_ok") & (F.col("_idx") == 0)).select(seq, F.col("_x").alias("shift"))


def place(items: DataFrame, movers: DataFrame, at: DataFrame, seq: str = "seq", idx: str = "idx", strict: bool = True, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """place_all() for one mover a sequence; at (seq, x)."""
    one = F.lit(0)
    return place_all(items, movers.withColumn("_mover", one), at.withColumn("_mover", one), seq, idx, "_mover", strict, kind)


def place_sequence(items: DataFrame, other: DataFrame, at: DataFrame, seq: str = "seq", idx: str = "idx", strict: bool = True, kind: str | None = None) -> DataFrame:
    """items with the whole sequence `other` (its rows' seq say where it goes) put in from x of at (seq, x) on: each of its runs
    of overlapping items at its own distance, all in one pass."""
    runs = overlap_groups(overlap_starts(other, [seq], idx, "length", "transition_length"), [seq], idx, "transition_length")
    spots = runs.groupBy(seq, "group_no").agg(F.min("start").alias("_start")).join(at.select(seq, "x"), seq).select(seq, "group_no", (F.col("x") + F.col("_start")).alias("x"))
    return place_all(items, runs, spots, seq, idx, "group_no", strict, kind)[0]


def rooms(items: DataFrame, moved: Column, by: Column, seq: str = "seq", idx: str = "idx") -> DataFrame:
    """items with `_own` (moved), `_by` and `_fits`: whether a moved item has room for its step.

    Items of one sequence move in turn, those ahead first, so each sees its neighbour where it went to."""
    w = Window.partitionBy(seq).orderBy(idx)
    d = items.withColumns({"_own": moved, "_by": F.when(moved, by).otherwise(0)})
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the others' order, so that a task sorts once
    step = F.max("_by").over(whole) + F.min("_by").over(whole)  # one is 0
    m = lambda k: F.coalesce(F.lead("_own", k).over(w), F.lit(False)).cast("int")
    b = lambda k: F.coalesce(F.lag("_own", k).over(w), F.lit(False)).cast("int")
    t = lambda k: F.coalesce((F.lead if k > 0 else F.lag)("transition_length", abs(k)).over(w), F.lit(0))
    d = d.withColumns({"_step": step, "_r": F.row_number().over(w)})
    d = d.withColumns({
        "_t1": t(1) - F.col("_step") * m(1), "_t2": t(2) + F.col("_step") * (m(1) - m(2)), "_l1": F.lead("length").over(w),
        "_t0": F.when(F.col("_r") > 1, F.col("transition_length") + F.col("_step") * b(1)).otherwise(0), "_tb": F.when(F.col("_r") > 2, t(-1) - F.col("_step") * b(1) + F.col("_step") * b(2)).otherwise(0), "_lb": F.lag("length").over(w),
    })
    right = F.least(F.col("_l1") - F.greatest("_t2", F.lit(0)) - F.col("_t1"), F.col("length") - F.col("_t1"))
    left = F.least(F.col("_lb") - F.col("_t0") - F.greatest("_tb", F.lit(0)), F.col("length") - F.col("_t0"))
    fits = F.when((F.col("_by") > 0) & F.col("_l1").isNotNull(), F.col("_by") <= right).when((F.col("_by") < 0) & F.col("_lb").isNotNull(), F.col("_by") >= -left).otherwise(True)
    return d.withColumn("_fits", fits).drop("_step", "_r", "_t0", "_t1", "_t2", "_tb", "_l1", "_lb")


def move_all(items: DataFrame, moved: Column, by: Column, seq: str = "seq", idx: str = "idx", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """items with all marked items of a sequence moved by the same step, and rows (seq, shift) of sequences whose
    first item moved. A sequence moves as a whole or, where one of its items has no room, not at all; with
    strict that is an error."""
    w = Window.partitionBy(seq).orderBy(idx)
    d = rooms(items, moved, by, seq, idx)
    d = d.withColumn("_all", F.min(F.col("_fits").cast("int")).over(Window.partitionBy(seq)) == 1)
    d = d.withColumn("_by", guarded(F.col("_all"), F.col("_by")) if strict else F.when(F.col("_all"), F.col("_by")).otherwise(0))
    first = F.row_number().over(w) == 1
    d = d.withColumns({"_first": first, "_prev": F.coalesce(F.lag("_by").over(w), F.lit(0))})
    shift = d.where("_first and _by <> 0").select(seq, F.col("_by").cast("long").alias("shift"))
    t = F.col("transition_length") + F.col("_prev") - F.when(F.col("_first"), 0).otherwise(F.col("_by"))
    return d.withColumn("transition_length", t.cast("long")).select(*items.columns), shift


def adjust_clip(items: DataFrame, where: Column, by: Column, what: str) -> DataFrame:
    """Clips with one side moved by a step: `length` (right), `start` (left), `top` or `height` (bottom).

    A side that would leave nothing of the clip is an error."""
    step = F.when(where, by).otherwise(0)
    size, sign = ("height", -1 if what == "top" else 1) if what in ("top", "height") else ("length", -1 if what == "start" else 1)
    out = {size: guarded(F.col(size) + sign * step > 0, F.col(size) + sign * step)}
    if what == "start":
        out |= {"x": F.col("x") + step, "offset": F.col("offset") + step}
    if what == "top":
        out["y"] = F.col("y") + step
    return items.withColumns(out)


def adjust_start(items: DataFrame, where: Column, by: Column, seq: str = "seq", idx: str = "idx") -> tuple[DataFrame, DataFrame]:
    """Sequence items that start later by a step, neighbours keeping their times, and rows (seq, shift) of sequences
    whose first item does. Without room in the item, before it or up to the next one's fade it is an error."""
    w = Window.partitionBy(seq).orderBy(idx)
    d = items.withColumns({"_by": F.when(where, by).otherwise(0), "_lb": F.lag("length").over(w), "_tb": F.greatest(F.lit(0), F.lag("transition_length").over(w)), "_t1": F.lead("transition_length").over(w)})
    length, t = F.col("length") - F.col("_by"), F.col("transition_length") - F.col("_by")
    room = (length >= 1) & F.coalesce(F.col("_lb") - F.col("_tb") - F.greatest(t, F.lit(0)) >= 0, F.lit(True)) & F.coalesce(length >= F.col("_t1"), F.lit(True))
    d = d.withColumn("_by", F.when(F.col("_by") != 0, guarded(room, F.col("_by"))).otherwise(0))
    shift = d.where("_lb is null and _by <> 0").select(seq, F.col("_by").cast("long").alias("shift"))
    out = d.withColumns({"length": length, "offset": F.col("offset") + F.col("_by"), "transition_length": F.when(F.col("_by") == 0, F.col("transition_length")).when(F.col("_lb").isNull(), 0).otherwise(t)})
    return out.select(*items.columns), shift


def adjust_length(items: DataFrame, where: Column, by: Column, seq: str = "seq", idx: str = "idx") -> DataFrame:
    """Sequence items that end later by a step, neighbours keeping their times; without room it is an error."""
    w = Window.partitionBy(seq).orderBy(idx)
    d = items.withColumns({"_by": F.when(where, by).otherwise(0), "_l1": F.lead("length").over(w), "_t1": F.lead("transition_length").over(w), "_t2": F.greatest(F.lit(0), F.coalesce(F.lead("transition_length", 2).over(w), F.lit(0)))})
    room = (F.col("length") + F.col("_by") >= 1) & F.coalesce(F.col("_l1") - (F.col("_t1") + F.col("_by")) - F.col("_t2") >= 0, F.lit(True))
    d = d.withColumn("_by", F.when(F.col("_by") != 0, guarded(room, F.col("_by"))).otherwise(0))
    d = d.withColumn("_prev", F.coalesce(F.lag("_by").over(w), F.lit(0)))
    return d.withColumns({"length": F.col("length") + F.col("_by"), "transition_length": F.col("transition_length") + F.col("_prev")}).select(*items.columns)
