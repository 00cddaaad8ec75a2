"""Scans and clusters in which one key holds most rows, against folds."""

import random

import pytest
from pyspark.sql import functions as F

from cuespan.operators import intervals, packets, ranges, scan


def test_running_sums_over_many_tasks(spark):
    r = random.Random(1)
    rows = [(0 if r.random() < 0.8 else r.randint(1, 5), k, r.randint(-5, 9)) for k in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as few rows would be one task's
    try:
        d = scan.numbered(spark.createDataFrame(rows, "k long, o long, v long"), ["k"], ["o"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    out = scan.running(d, ["k"], {"before": F.col("v"), "pos": F.lit(1)}, {"top": F.col("v")}).collect()
    assert d.where("k = 0").select(F.shiftright("_row", 33)).distinct().count() > 1
    held = {}
    want = {}
    for k, o, v in rows:
        s, n, m = held.get(k, (0, 0, v))
        want[o] = (s, n, max(m, v))
        held[k] = (s + v, n + 1, max(m, v))
    assert {x.o: (x.before, x.pos, x.top) for x in out} == want


def fold(rows, ticks, most):
    out, held = {}, {}
    for k, o, t, n in sorted(rows):
        start, size, c = held.get(k, (t, 0, 0))
        if (k in held) and (abs(t - start) > ticks or size > most):
            start, size, c = t, 0, c + 1
        out[o] = c
        held[k] = (start, size + n, c)
    return out


@pytest.mark.parametrize(("back", "ticks", "most"), [(0, 50, 10**9), (0, 10**6, 900), (40, 50, 400), (90, 50, 400)])
def test_clusters_are_the_fold(spark, back, ticks, most):
    r = random.Random(back + ticks)
    rows, now = [], 0
    for o in range(1500):
        now += r.choice([0, 0, 1, 3, 8, 120 if r.random() < 0.02 else 2])
        rows.append((0 if r.random() < 0.8 else r.randint(1, 9), o, now - (r.randint(0, back) if back else 0), r.randint(0, 200)))
    df = spark.createDataFrame(rows, "k long, o long, t long, n long")
    out = packets.clusters(df, "k", ["o"], "t", "n", ticks, most)
    assert {x.o: x.cluster for x in out.collect()} == fold(rows, ticks, most)
    assert packets.clusters(df.limit(0), "k", ["o"], "t", "n").count() == 0
    if back <= ticks:
        assert "mapInPandas" not in out._jdf.queryExecution().toString() and "MapInPandas" not in out._jdf.queryExecution().toString()


def test_one_long_stream(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("k"), "id", F.lit(100).alias("n"))
    out = packets.clusters(df, "k", ["id"], "id", "n", ticks=999)
    assert out.where(F.col("cluster") != F.floor(F.col("id") / 1000)).count() == 0


@pytest.mark.parametrize("floats", [False, True])
def test_box_pairs_are_all_pairs(spark, floats):
    r = random.Random(7)
    size = lambda: r.choice([0, 1, 1, 2, 3, 4, 16, 17, 64, 300]) / (8 if floats else 1)
    rows = [(r.randint(0, 1), k, float(r.randint(-60, 60)), float(size()), float(r.randint(-60, 60)), float(size())) for k in range(150)]
    df = spark.createDataFrame(rows, "g long, id long, x double, l double, y double, h double")
    df = df if floats else df.selectExpr("g", "id", *[f"cast({c} as long) as {c}" for c in "xlyh"])
    got = [(q.a, q.b) for q in intervals.box_overlaps(df, "id", "x", "l", "y", "h", ["g"]).collect()]
    want = {(p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] != q[1] and min(p[3], p[5], q[3], q[5]) > 0 and p[2] < q[2] + q[3] and q[2] < p[2] + p[3] and p[4] < q[4] + q[5] and q[4] < p[4] + p[5]}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_boxes_that_share_one_axis_only(spark):
    """A million boxes of one place in x meet only their neighbours in y."""
    df = spark.range(1_000_000).select("id", F.lit(0).alias("x"), F.lit(10).alias("l"), (F.col("id") * 2).alias("y"), F.lit(3).alias("h"))
    assert intervals.box_overlaps(df, "id", "x", "l", "y", "h").count() == 2 * 999_999


def test_fill_by_blocks(spark):
    df = spark.createDataFrame([(1, -5000, 1.0), (1, 9000, 2.0), (2, 3, 4.0), (3, None, 1.0)], "k int, f int, v double")
    out = ranges.fill(df, "f", "v", ["k"])
    assert {(r.k, r.n, r.s, r.lo, r.hi) for r in out.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.min("f").alias("lo"), F.max("f").alias("hi")).collect()} == {(1, 14001, 3.0, -5000, 9000), (2, 1, 4.0, 3, 3)}
    assert out.select("f").distinct().count() == 14001 and out.schema["f"].dataType.simpleString() == "int"
