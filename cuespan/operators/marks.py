"""Marks in lists that are spliced: splices as maps of places, composed by a tree.

A splice moves a mark at place i: before `start` it stays, from start to stop (ends counted) it goes to where its gravity
draws it, behind that it moves with what follows. That is a rising map in three pieces, each either a shift or one
place. Maps of neighbouring splices are composed block by block, and blocks of blocks after that, so that of m splices
each is met some log(m) times; a list's marks then look up the one piece that they lie in.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .graph import fresh

#: Splices of a first block, blocks of a later one, and a place before all others.
FIRST, FAN, LOWEST = 512, 16, -(1 << 62)

Map = tuple[np.ndarray, np.ndarray, np.ndarray]  # where pieces begin, whether they are one place, that place or the shift


def splice_map(start: int, stop: int, new: int, left: bool) -> Map:
    return np.array([LOWEST, start, stop + 1]), np.array([False, True, False]), np.array([0, start if left else start + new, new - (stop - start)])


def _at(m: Map, x: np.ndarray) -> np.ndarray:
    return np.searchsorted(m[0], x, side="right") - 1


def then(f: Map, g: Map) -> Map:
    """The map that is f and after it g."""
    lo, one, by = f
    end = np.r_[lo[1:], -LOWEST]
    # where g's pieces begin inside what f shifts
    image = np.where(one, by, lo + by)
    q = g[0][1:]
    j = np.clip(np.searchsorted(image, q, side="left") - 1, 0, None)
    x = q - by[j]
    x = x[~one[j] & (x > lo[j]) & (x < end[j])]
    at = np.unique(np.r_[lo, x])
    k = _at(f, at)
    here = np.where(one[k], by[k], at + by[k])
    p = _at(g, here)
    fixed = one[k] | g[1][p]
    value = np.where(g[1][p], g[2][p], np.where(one[k], here + g[2][p], by[k] + g[2][p]))
    new = np.r_[True, (fixed[1:] != fixed[:-1]) | (value[1:] != value[:-1])]
    return at[new], fixed[new], value[new]


def _all(maps: list[Map]) -> Map:
    while len(maps) > 1:
        maps = [then(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def _grouped(batches, keys: list[str], make):
    """Over record batches that are sorted by keys, which stand first: make(columns) is the map of each run of rows with equal
    keys. Many short runs are met in one batch, as a call and a frame for each would cost more than its map."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def starts(t) -> np.ndarray:
        new = np.r_[True, np.zeros(t.num_rows - 1, bool)]
        for k in keys:
            c = pa.concat_arrays(t.column(k).chunks)
            none = c.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False) | (none[1:] != none[:-1])
        return np.flatnonzero(new)

    def made(t, at: np.ndarray):
        cols = {c: t.column(c).to_numpy() for c in ("left_gravity", *[c for c in t.column_names if c not in keys])}
        maps = [make({c: v[lo:hi] for c, v in cols.items()}) for lo, hi in zip(at, [*at[1:], t.num_rows], strict=True)]
        out = t.select(keys).take(pa.array(np.repeat(at, [len(m[0]) for m in maps])))
        for i, c in enumerate(("lo", "fixed", "value")):
            out = out.append_column(c, pa.array(np.concatenate([m[i] for m in maps])))
        return out.combine_chunks().to_batches()

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        at = starts(held)
        if len(at) > 1:  # the last run may go on
            yield from made(held.slice(0, at[-1]), at[:-1])
            held = held.slice(at[-1])
    if held is not None:
        yield from made(held, np.array([0]))


def composed(splices: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left_gravity, lo, fixed, value): the pieces of each list's map after all its splices
    (keys, step, start, stop, new_length) in order of step."""
    d = scan.running(scan.numbered(splices, keys, ["step"]), keys, {"_pos": F.lit(1)})
    d = d.select(*keys, "_pos", *[F.col(c).cast("long").alias(c) for c in ("start", "stop", "new_length")]).withColumn("left_gravity", F.explode(F.array(F.lit(True), F.lit(False))))
    names = [f"`{k}` {splices.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*names, "left_gravity boolean, _block bigint, lo bigint, fixed boolean, value bigint"])
    group = [*keys, "left_gravity", "_block"]

    def first(c) -> Map:
        return _all([splice_map(a, b, n, c["left_gravity"][0]) for a, b, n in zip(c["start"], c["stop"], c["new_length"], strict=True)])

    def later(c) -> Map:
        at = np.flatnonzero(np.r_[True, c["_own"][1:] != c["_own"][:-1]])
        return _all([tuple(c[n][i:j] for n in ("lo", "fixed", "value")) for i, j in zip(at, [*at[1:], len(c["_own"])], strict=True)])

    def maps(d: DataFrame, order: list[str], make) -> DataFrame:
        d = d.select(*group, *[c for c in d.columns if c not in group]).repartition(*group).sortWithinPartitions(*group, *order)
        return fresh(d.mapInArrow(lambda batches: _grouped(batches, group, make), schema))

    d = maps(d.withColumn("_block", F.floor(F.col("_pos") / FIRST)), ["_pos"], first)
    while (d.agg(F.max("_block")).first()[0] or 0) > 0:
        d = maps(d.withColumn("_own", F.col("_block")).withColumn("_block", F.floor(F.col("_block") / FAN)), ["_own", "lo"], later)
    return d.drop("_block")


def shift_marks(marks: DataFrame, splices: DataFrame, keys: list[str]) -> DataFrame:
    """marks (keys, index, left_gravity) after all splices (keys, step, start, stop, new_length) of their lists."""
    pieces = composed(splices.join(marks.select(*keys).distinct(), keys, "left_semi"), keys)  # lists without marks need no map
    cols = [c for c in marks.columns if c not in keys]
    group = [*keys, "left_gravity"]
    # along each list's places, pieces before marks: the greatest beginning so far is that of a mark's piece
    both = pieces.select(*group, F.col("lo").alias("_x"), F.lit(0).alias("_kind"), F.lit(None).cast(marks.select(F.struct(*cols).alias("m")).schema["m"].dataType).alias("_m"))
    both = both.unionByName(marks.select(*group, F.col("index").cast("long").alias("_x"), F.lit(1).alias("_kind"), F.struct(*cols).alias("_m")))
    d = scan.running(scan.numbered(both, group, ["_x", "_kind"]), group, greatest={"lo": F.when(F.col("_kind") == 0, F.col("_x"))})
    d = d.where("_kind = 1").join(pieces, [*group, "lo"], "left")
    to = F.when(F.col("fixed"), F.col("value")).otherwise(F.col("_x") + F.coalesce("value", F.lit(0)))
    return d.select(*keys, "_m.*", to.alias("_to")).withColumn("index", F.col("_to")).drop("_to").select(*marks.columns)
