"""Closures and orders of deep graphs, against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from cuespan.operators import graph, intervals, scan


def plain(start, edges):
    on = {}
    for a, b in edges:
        on.setdefault(a, set()).add(b)
    out = set()
    for o in start:
        seen, todo = {o}, [o]
        while todo:
            for x in on.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        out |= {(o, x) for x in seen}
    return out


def shapes(r, kind):
    n = 60
    if kind == "random":
        return [(r.randrange(n), r.randrange(n)) for _ in range(70)]
    if kind == "trees and chains":
        return [(i // 2, i) for i in range(1, 20)] + [(i, i + 1) for i in range(19, 50)] + [(50, 30), (25, 55), (55, 56)]
    if kind == "two ways":
        return [e for i in range(40) for e in ((i, i + 1), (i + 1, i))] + [(40, 41), (41, 42), (42, 50), (50, 41), (43, 7)]
    return [(i, i + 1) for i in range(40)] + [(i, 100 + i) for i in range(40)] + [(100 + i, 200 + i) for i in range(0, 40, 3)]  # a way with twigs


@pytest.mark.parametrize("kind", ["random", "trees and chains", "two ways", "twigs"])
def test_closure_is_the_plain_search(spark, kind):
    edges = shapes(random.Random(4), kind)
    start = [0, 3, 17, 41, 999]
    got = graph.closure(spark.createDataFrame([(x,) for x in start], "origin long"), spark.createDataFrame(edges, "source long, target long"), rounds=1)
    rows = [tuple(x) for x in got.select("origin", "node").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(start, edges)


def written(monkeypatch):
    """Counts the tables that a search writes."""
    n, own = [0], graph.fresh

    def fresh(df):
        n[0] += 1
        return own(df)

    monkeypatch.setattr(graph, "fresh", fresh)
    return n


@pytest.mark.parametrize("circle", [False, True])
def test_chain_and_circle_of_many(spark, monkeypatch, circle):
    n = 100_000
    edges = spark.range(n if circle else n - 1).select(F.col("id").alias("source"), ((F.col("id") + 1) % n).alias("target"))
    count = written(monkeypatch)
    got = graph.closure(spark.createDataFrame([(5,)], "origin long"), edges)
    assert got.count() == (n if circle else n - 5) and count[0] < 80


def test_depths_of_many(spark, monkeypatch):
    n = 100_000
    count = written(monkeypatch)
    ties = spark.range(2 * n).select(F.col("id").alias("source"), F.when(F.col("id") < n, F.col("id") - 1).otherwise(n + (F.col("id") + 1) % n).alias("target"))
    out = graph.anchor_order(spark.range(2 * n).withColumn("rate", F.col("id") % 10), ties).cache()
    assert out.where("id < 100000 and depth <> id").count() == 0  # a chain
    assert out.where("id >= 100000 and depth <> (200000 - id) % 100000").count() == 0  # a circle, broken at its first item
    assert count[0] < 100


def test_parts_of_a_chain_in_order(spark, monkeypatch):
    count = written(monkeypatch)
    got = graph.parts(spark.range(5000).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target")).unionByName(spark.createDataFrame([(9000, 7000), (9000, 8000)], "source long, target long")))
    assert got.groupBy("part").count().orderBy("part").collect() == [(0, 5001), (7000, 3)] and count[0] < 30


def tied_parts(ids, links):
    part = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    return part


@pytest.mark.parametrize("loners", [0, 3])
def test_orders_of_many_anchors_and_circles(spark, loners):
    """Rounds that look at what is tied alone give the depths of rounds over all items."""
    r = random.Random(loners)
    rates = {i: r.randrange(4) for i in range(40 + loners)}
    ties = {(a, b) for a, b in ((r.randrange(40), r.randrange(44)) for _ in range(55))} | {(i, (i + 1) % 5) for i in range(5)}
    want, left, depth = {}, set(rates), 0
    tied = {(a, b) for a, b in ties if a != b and b in left}
    while left:
        free = left - {a for a, _ in tied}
        if not free:
            part = tied_parts(left, tied)
            free = {min((rates[i], i) for i in left if part[i] == p)[1] for p in set(part.values())}
        want |= dict.fromkeys(free, depth)
        left, tied, depth = left - free, {(a, b) for a, b in tied if a not in free and b not in free}, depth + 1
    got = graph.anchor_order(spark.createDataFrame([*rates.items()], "id long, rate int"), spark.createDataFrame([*ties], "source long, target long"))
    assert {x.id: x.depth for x in got.collect()} == want


def test_stacks_of_boxes_are_the_plain_order_and_write_items_once(spark, monkeypatch):
    """Of a table of which most overlap nothing, no round writes the whole; overlaps may come one way round with their y and z."""
    r = random.Random(8)
    boxes = [(i, r.randrange(150), r.randint(1, 9), r.randrange(6), 2, r.randrange(9)) for i in range(60)] + [(i, 10 * i, 1, i % 50, 1, i % 7) for i in range(100, 1600)]
    pairs = [(p[0], q[0]) for p in boxes for q in boxes if p[0] != q[0] and p[1] < q[1] + q[2] and q[1] < p[1] + p[2] and p[3] < q[3] + q[4] and q[3] < p[3] + p[4]]
    y, z = {b[0]: b[3] for b in boxes}, {b[0]: b[5] for b in boxes}
    part, depth, top = tied_parts(y, pairs), dict.fromkeys(y, 0), {}
    for _ in range(60):
        for a, b in pairs:
            if z[b] > z[a]:
                depth[a] = max(depth[a], depth[b] + 1)
    for i in y:
        top[part[i]] = max(top.get(part[i], -1), y[i])
    want = sorted(y, key=lambda i: (-top[part[i]], part[i], depth[i], -y[i], -z[i], i))
    assert max(depth.values()) > 2
    df = spark.createDataFrame(boxes, "id long, x long, l long, y long, h long, z long")
    laps, lean = intervals.box_overlaps(df, "id", "x", "l", "y", "h", kept=["y", "z"]), intervals.box_overlaps(df, "id", "x", "l", "y", "h")
    assert laps.columns == ["a", "b", "a_y", "a_z", "b_y", "b_z"] and sorted(map(tuple, lean.collect())) == sorted(pairs)
    rows, own = [], graph.fresh
    for module in (graph, scan):
        monkeypatch.setattr(module, "fresh", lambda d: (out := own(d), rows.append(out.count()))[0])
    for o in (laps, lean, laps.where("a > b")):
        rows.clear()
        got = graph.stack_order(df.select("id", "y", "z"), o).collect()
        assert [x.id for x in sorted(got, key=lambda x: x.paint)] == want and {x.paint for x in got} == set(range(len(want)))
        assert sum(n > len(boxes) / 2 for n in rows) == 2  # with their stacks, and sorted
