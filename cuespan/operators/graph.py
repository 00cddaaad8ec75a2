"""Reachability over anchors and overlaps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecode import NS, frame_time, time_frame


def both_ways(edges: DataFrame, source: str, target: str, two_way: str) -> DataFrame:
    """Directed edges (source, target): a two-way one gives both."""
    one = edges.select(F.col(source).alias("source"), F.col(target).alias("target"))
    back = edges.where(F.col(two_way)).select(F.col(target).alias("source"), F.col(source).alias("target"))
    return one.unionByName(back).distinct()


def fresh(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there, so that a loop's plans don't grow.

    The folder is that of the session. Only a local session without one gets a folder of its own."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new name under the session's checkpoint folder, which is set where it isn't yet."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="checkpoint-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def reach(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(origin, node, depth): all that start (origin) reaches over edges (source, target), itself at depth 0.

    A breadth-first round joins the newest nodes alone and drops those known, so cycles end. There are as
    many rounds as the longest shortest way has edges; closure() has fewer where depths aren't asked for.
    """
    return reach_from(start.select("origin", F.col("origin").alias("node")), edges)


def reach_from(front: DataFrame, edges: DataFrame) -> DataFrame:
    """reach() from rows (origin, node)."""
    seen = front = fresh(front.select("origin", "node", F.lit(0).alias("depth")).distinct())
    depth = 0
    while not front.isEmpty():
        depth += 1
        nxt = front.join(edges, front["node"] == edges["source"]).select("origin", F.col("target").alias("node")).distinct()
        front = fresh(nxt.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front) if depth % 8 else fresh(seen.unionByName(front))
    return seen


def closure(start: DataFrame, edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(origin, node): all that start (origin) reaches over edges (source, target), itself included.

    Most graphs are done after a few breadth-first rounds. What is deeper is contracted and searched as a smaller graph:
    nodes tied both ways become one; nodes without edges onward are left to the end; and ways along
    nodes with one edge onward are taken in steps that double. So chains, circles and trees, however
    deep, take rounds that grow with the logarithm of their size, and a graph that nothing contracts is searched by reach().
    """
    edges = fresh(edges.select("source", "target").where("source <> target").distinct())
    return _closure(fresh(start.select("origin", F.col("origin").alias("node")).distinct()), edges, rounds)


def _closure(seen: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    front = seen
    for _ in range(rounds):
        nxt = front.join(edges, front["node"] == edges["source"]).select("origin", F.col("target").alias("node")).distinct()
        front = fresh(nxt.join(seen, ["origin", "node"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = fresh(seen.unionByName(front))
    return fresh(seen.unionByName(_contracted(front, edges, rounds)).distinct())


def _relabelled(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """df with a column's values that names (id, part) has replaced by their part."""
    return df.join(names.select(F.col("id").alias(column), "part"), column, "left").withColumn(column, F.coalesce("part", column)).drop("part")


def _contracted(front: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    ties = edges.join(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), ["source", "target"]).where("source < target")
    if not ties.isEmpty():
        names = parts(ties)
        small = _relabelled(_relabelled(edges, "source", names), "target", names).where("source <> target").distinct()
        got = _closure(fresh(_relabelled(front, "node", names).distinct()), fresh(small), rounds)
        return got.join(names, got["node"] == names["part"], "left").select("origin", F.coalesce("id", "node").alias("node"))
    goes_on = edges.select(F.col("source").alias("target")).distinct()
    inner, last = fresh(edges.join(goes_on, "target", "left_semi")), fresh(edges.join(goes_on, "target", "left_anti"))
    onward = inner.groupBy("source").agg(F.count("*").alias("n"), F.min("target").alias("to"))
    jump = fresh(onward.where("n = 1").select(F.col("source").alias("node"), "to"))
    forks = fresh(inner.join(onward.where("n > 1").select("source"), "source"))
    # jumps of 1, 2, 4 ... edges, up to the longest way without a fork; circles have no end
    most, jumps = jump.count(), []
    while not jump.isEmpty():
        jumps.append(jump)
        if 1 << len(jumps) > most:
            break
        jump = fresh(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("_to")), "to").select("node", F.col("_to").alias("to")))
    entries = front
    if not forks.isEmpty():
        ends = jumps[0] if jumps else None
        for _ in jumps[1:]:
            ends = fresh(ends.join(ends.select(F.col("node").alias("to"), F.col("to").alias("_to")), "to", "left").select("node", F.coalesce("_to", "to").alias("to")))
        at_fork = forks.select(F.col("source").alias("target")).distinct()

        def led(df: DataFrame, column: str) -> DataFrame:
            """df with a column's nodes led along to the fork where their way ends; without those that lead to none."""
            df = _relabelled(df, column, ends.select(F.col("node").alias("id"), F.col("to").alias("part"))) if ends is not None else df
            return df.join(at_fork.withColumnRenamed("target", column), column, "left_semi").distinct()

        small = fresh(led(forks, "target").where("source <> target"))
        if 10 * small.count() > 9 * edges.count():
            return reach_from(front, edges).select("origin", "node")
        got = _closure(fresh(led(front, "node")), small, rounds)
        entries = fresh(front.unionByName(got.join(forks, got["node"] == forks["source"]).select("origin", F.col("target").alias("node"))).distinct())
    for jump in jumps:
        entries = fresh(entries.unionByName(entries.join(jump, "node").select("origin", F.col("to").alias("node"))).distinct())
    return entries.unionByName(entries.join(last, entries["node"] == last["source"]).select("origin", F.col("target").alias("node")))


def parts(links: DataFrame) -> DataFrame:
    """(id, part) of the ends of links (source, target): the least id that links tie each to, either way.

    Each round every node takes the least of itself and its neighbours, pointers are followed to their ends, and the graph is
    contracted to those: at most half the nodes that have links stay."""
    return _parts(fresh(links.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).where("u <> v").distinct()))


def _parts(e: DataFrame) -> DataFrame:
    """parts() of stored links (u, v), each once and u the lesser."""
    named = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = fresh(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("part")))
        # a pointer to a node that points to itself is at its end, and is not followed again
        ends, ways = to.where("id = part"), to.where("id <> part")
        moving, there = ways, None
        while True:
            far = ways.select(F.col("id").alias("part"), F.col("part").alias("_far"))
            nxt = fresh(moving.join(far, "part", "left").select("id", F.coalesce("_far", "part").alias("part"), F.col("_far").isNotNull().alias("_moved")))
            rest = nxt.where("not _moved").select("id", "part")
            there = rest if there is None else there.unionByName(rest)
            moving = nxt.where("_moved").select("id", "part")
            if moving.isEmpty():
                break
            ways = there.unionByName(moving)
        to = ends.unionByName(there)
        named = to if named is None else fresh(_relabelled(named.withColumnRenamed("part", "_p"), "_p", to).select("id", F.col("_p").alias("part")))
        e = _relabelled(_relabelled(e, "u", there), "v", there)
        e = fresh(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    return e.select(F.col("u").alias("id"), F.col("v").alias("part")) if named is None else named


def overlap_stack(start: DataFrame, overlaps: DataFrame, z: DataFrame) -> DataFrame:
    """What lies over or under each origin through overlaps that go straight up or straight down in z.

    overlaps (a, b) both ways; z (id, z)."""
    e = overlaps.join(z.select(F.col("id").alias("a"), F.col("z").alias("za")), "a").join(z.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
    e = fresh(e.select("a", "b", (F.col("zb") > F.col("za")).alias("up"), (F.col("zb") < F.col("za")).alias("down")))
    ways = [closure(start, e.where(way).select(F.col("a").alias("source"), F.col("b").alias("target"))) for way in ("up", "down")]
    return ways[0].unionByName(ways[1]).where("origin <> node").distinct()


def anchored_x(target_x: Column, offset_ns: Column, tn: int, td: int, n: int, d: int) -> Column:
    """Where an anchored item belongs on its own time line of n / d frames a second: its target's place at
    tn / td and an offset in nanoseconds, rounded to the nearest frame; whole numbers throughout."""
    half = F.lit(NS * d // (2 * n) + 1)
    return time_frame(frame_time(target_x, tn, td) + offset_ns + half, n, d)


def anchored_y(target_y: Column, offset: Column) -> Column:
    """Where an anchored item belongs from top to bottom."""
    return target_y + offset


def _halved(d: DataFrame) -> DataFrame:
    """Rows (id, to, dist, least) where `to` and what is known of it are taken one doubling further."""
    far = d.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("dist").alias("_dist"), F.col("least").alias("_least"))
    out = d.join(far, "to", "left").select("id", F.coalesce("_to", "to").alias("to"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"), F.least("least", F.coalesce("_least", "least")).alias("least"), F.col("_to").isNotNull().alias("open"))
    return fresh(out)


def _depths(tied: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, depth) where each source of tied (source, target) has one target; ranks (id, rank).

    Steps along targets double until all ways end. Where they don't end, they have led to a circle; of a
    circle, the item of the least rank is let go of, and steps are taken anew."""
    first = tied.join(ranks, tied["source"] == ranks["id"]).select("id", F.col("target").alias("to"), F.lit(1).cast("long").alias("dist"), F.col("rank").alias("least"))
    n, steps, d = tied.count(), 1, fresh(first)
    if not n:
        return d.select("id", F.col("dist").alias("depth"))
    while steps <= n:
        d, steps = _halved(d), steps * 2
        if d.where("open").isEmpty():
            return d.select("id", F.col("dist").alias("depth"))
    rings = d.where("open").select(F.col("to").alias("id")).distinct()
    ring, steps = fresh(first.join(rings, "id", "left_semi")), 1
    while steps <= n:  # over the whole of each circle
        ring, steps = _halved(ring), steps * 2
    free = fresh(ring.where("least.id = id").select(F.col("id").alias("source")))
    return _depths(fresh(tied.join(free, "source", "left_anti")), ranks).unionByName(free.select(F.col("source").alias("id"), F.lit(0).cast("long").alias("depth")))


def _ordered(tied: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, depth) of the items that don't come first, as anchor_order() has it; tied (source, target) is stored, has each row
    once and ties items of ranks (id, rank) alone.

    A round looks at what is tied and no more: targets that are no sources are placed, and ties to them are met. A source comes
    as many places later as there are rounds in which it still is one."""
    sources = lambda: fresh(tied.select(F.col("source").alias("id")).distinct())
    goes = sources()
    m = goes.count()
    if m == tied.count():
        return _depths(tied, ranks)
    n, depth, placed = ranks.count(), 0, None
    while m:
        target, source = F.col("id").alias("target"), F.col("id").alias("source")
        if m == n:  # none is free
            free = goes.join(ranks, "id").join(parts(tied), "id", "left").groupBy(F.coalesce("part", "id")).agg(F.min("rank").alias("rank"))
            free = fresh(free.select("rank.id"))
            goes = fresh(goes.join(free, "id", "left_anti"))
            m = goes.count()
            tied = fresh(tied.join(free.select(target), "target", "left_anti").join(free.select(source), "source", "left_anti"))
        else:
            tied = fresh(tied.join(goes.select(target), "target", "left_semi"))
        n, depth = m, depth + 1
        rows = goes.withColumn("depth", F.lit(depth).cast("long"))
        placed = rows if placed is None else placed.unionByName(rows)
        goes = sources()
        m = goes.count()
    return placed.groupBy("id").agg(F.max("depth").alias("depth"))


def anchor_order(items: DataFrame, anchors: DataFrame) -> DataFrame:
    """items (id, rate, ...) with `depth`: every item comes after the targets of its anchors (source, target).

    A circle is broken at its item of the lowest rate, of equal ones at the least id. Where items have one anchor each, depths
    come from steps that double. Else each round places the items whose targets are all placed; where none is left but
    circles, what is tied together gives way at its item of the lowest rate, and the rounds go on."""
    ranks = fresh(items.select("id", F.struct("rate", "id").alias("rank")))
    tied = anchors.select("source", "target").where("source <> target").distinct()
    tied = fresh(tied.join(ranks.select(F.col("id").alias("target")), "target", "left_semi").join(ranks.select(F.col("id").alias("source")), "source", "left_semi"))
    return items.join(_ordered(tied, ranks), "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)).cast("int"))


def stack_order(items: DataFrame, overlaps: DataFrame) -> DataFrame:
    """items (id, y, z, ...) with `paint` from 0, the order in which they are painted.

    Of two that overlap (rows (a, b) of overlaps, one way round or both), the one with the greater z comes first. That alone ties only
    those; others go by y, the greatest first. As both rules together can run in a circle, they are taken apart: what overlaps, directly or
    by others between, is a stack; stacks come by their greatest y; in a stack, an item comes after all that it must lie on, by the
    longest way of overlaps up to it, and items of one such depth by y, z and id.

    Where the join that found the overlaps kept y and z of both (a_y, a_z, b_y, b_z), items are not looked up for them."""
    from . import scan

    if not {"a_y", "a_z", "b_y", "b_z"} <= set(overlaps.columns):
        for end in "ab":
            own = items.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in "yz"])
            overlaps = overlaps.drop(f"{end}_y", f"{end}_z").join(own, end, "left")
    a, b = (F.struct(F.col(end).alias("id"), F.col(f"{end}_y").alias("y"), F.col(f"{end}_z").alias("z")) for end in "ab")
    pairs = fresh(overlaps.where("a <> b").select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    stacks = _parts(pairs.select("u.id", F.col("v.id").alias("v")).withColumnRenamed("id", "u"))
    over = F.col("u.z") > F.col("v.z")
    ties = fresh(pairs.where("u.z <> v.z").select(F.when(over, F.col("v.id")).otherwise(F.col("u.id")).alias("source"), F.when(over, F.col("u.id")).otherwise(F.col("v.id")).alias("target")))
    deep = _ordered(ties, stacks.select("id", F.struct("id").alias("rank")))
    tops = pairs.select(F.col("u.id").alias("id"), F.greatest("u.y", "v.y").alias("y")).join(stacks, "id").groupBy("part").agg(F.max("y").alias("_top"))
    stacked = stacks.join(deep, "id", "left").join(tops, "part")
    d = items.join(stacked, "id", "left").withColumns({"part": F.coalesce("part", "id"), "depth": F.coalesce("depth", F.lit(0)), "_top": F.coalesce("_top", "y")})
    order = [F.desc("_top"), F.asc("part"), F.asc("depth"), F.desc("y"), F.desc("z"), F.asc("id")]
    return scan.placed(fresh(d), order, "paint").select(*items.columns, "paint")
