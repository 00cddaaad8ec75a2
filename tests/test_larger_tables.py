"""What shows on larger tables alone: plans of joins by bins, and ties."""

import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cuespan.operators import intervals, marks, nesting, placement
from cuespan.plans import queries
from cuespan.sources import binned


def same_as_sql(spark, d, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in d.iterdir():
        con.execute(f"create view {f.name.split('.')[0]} as select * from '{f}{'/*.parquet' if f.is_dir() else ''}'")
    cols = con.execute(f"describe {queries.SQL[name]}").df()["column_name"].tolist()
    got = queries.QUERIES[name](spark, str(d)).select(*cols).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.execute(queries.SQL[name]).fetchall(), key=repr)
    assert got


def test_no_side_of_a_join_by_bins_is_broadcast(spark):
    """Few rows that stand for many points or bins: their size is underestimated."""
    p = spark.createDataFrame([(1,)], "k long").withColumn("f", F.explode(F.expr("sequence(0L, 9999L)")))
    i = spark.createDataFrame([(1, 5, 70)], "k long, x long, length long")
    boxes = i.select("k", F.lit(1).alias("id"), "x", F.col("length").alias("l"), F.lit(0).alias("y"), F.lit(1).alias("h"))
    joins = [
        intervals.stab_join(p, i, "f", keys=["k"]), intervals.box_overlaps(boxes, "id", "x", "l", "y", "h", ["k"]),
        intervals.overlap_join(i.select("k", F.col("x").alias("ax"), F.col("length").alias("al")), i.select("k", F.col("x").alias("bx"), F.col("length").alias("bl")), "ax", "al", "bx", "bl", ["k"]),
    ]
    assert [len(j.collect()) for j in joins] == [70, 0, 1]
    for j in joins:
        assert "Broadcast" not in j._jdf.queryExecution().executedPlan().toString()


def test_what_a_space_shows_comes_in_order(spark):
    """All pairs of two large tables: a file of them is small if equal windows show the same run of items after each other."""
    r = random.Random(3)
    schema = "space long, z long, x long, length long, offset long"
    outer = [(0, k, r.randint(0, 900), r.randint(1, 9), r.randint(0, 40)) for k in range(150)]
    inner = [(0, k, r.randint(0, 40), r.randint(1, 20), 0) for k in range(60)]
    o, i = spark.createDataFrame(outer, schema).repartition(3), spark.createDataFrame(inner, schema).repartition(3)
    got = [(g.outer_z, g.z) for g in nesting.nested(o, i, "space", ordered=True).collect()]
    pairs = {(a[1], b[1]) for a in outer for b in inner if a[4] < b[2] + b[3] and b[2] < a[4] + a[3]}
    assert len(got) == len(pairs) and set(got) == pairs
    at = {k: (offset, length) for _, k, _, length, offset in outer}
    runs = [(k, [z for _, z in g]) for k, g in itertools.groupby(got, lambda p: p[0])]
    assert len(runs) == len({k for k, _ in runs}) and [at[k] for k, _ in runs] == sorted(at[k] for k, _ in runs)
    assert all([inner[z][2:4] for z in zs] == sorted(inner[z][2:4] for z in zs) for _, zs in runs)


def test_equal_windows_show_an_item_together(spark):
    """The run of an item is as long as its windows are many, and theirs again for the next item, whatever the items are."""
    r = random.Random(9)
    schema = "space long, z long, x long, length long, offset long"
    at = [(7 * k, 2 + k) for k in range(6)]
    outer = [(k % 2, k, r.randint(0, 900), at[k % 6][1], at[k % 6][0]) for k in range(90)]
    inner = [(k % 2, k, r.randint(0, 40), r.randint(1, 20), r.randint(0, 5)) for k in range(70)]
    o, i = spark.createDataFrame(outer, schema).repartition(3), spark.createDataFrame(inner, schema).repartition(3)
    got = nesting.nested(o, i, "space", sets=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, nesting.nested(o, i, "space").select(*got.columns).collect()))
    runs = [(k, [g.outer_z for g in gs]) for k, gs in itertools.groupby(got.collect(), lambda g: (g.z, g.outer_z % 6))]
    assert len(runs) == len({k for k, _ in runs}) > 20
    sets = {w: ks for (_, w), ks in runs}
    assert all(ks == sets[w] and len(ks) == 15 for (_, w), ks in runs)


def test_equal_windows_meet_an_item_together(spark, tmp_path):
    """An item repeats for all equal windows, and these for the next item: runs that a columnar file keeps in little room."""
    r = random.Random(8)
    items = [(k, r.randint(0, 400), r.choice([1, 15, 40, 90])) for k in range(80)]
    windows = [(k, 60 * (k % 5), 60 * (k % 5) + 30) for k in range(60)]
    path = str(tmp_path / "items")
    binned.write_binned(spark.createDataFrame(items, "id long, x long, length long"), path, 512)
    w = spark.createDataFrame(windows, "w long, lo long, hi long").repartition(3)
    got = [(g.w, g.id) for g in binned.join_windows(spark, path, 512, w).collect()]
    assert sorted(got) == sorted((k, i) for k, a, b in windows for i, x, n in items if x < b and x + n > a)
    runs = [(i, [k for k, _ in g]) for i, g in itertools.groupby(got, lambda p: (p[1], p[0] % 5))]
    assert len(runs) == len({i for i, _ in runs}) and all(ks == list(range(i[1], 60, 5)) for i, ks in runs)


def test_sets_have_a_greatest_size(spark, monkeypatch):
    """Many equal intervals are several sets, none of them larger than that, whatever the other columns hold."""
    monkeypatch.setattr(intervals, "SET", 4)
    d = spark.createDataFrame([(k % 3, k, {"a": k}) for k in range(40)], "x long, k long, m map<string, long>")
    got = intervals.gathered(d, ["x"], "rows").collect()
    assert sorted((g.x, r.k, r.m["a"]) for g in got for r in g.rows) == sorted((k % 3, k, k) for k in range(40))
    assert sorted(len(g.rows) for g in got) == [1, 1, 2, *[4] * 9]


def test_grid_points_that_items_hold(spark):
    r = random.Random(5)
    items = [(k, r.randint(-200, 200), r.choice([0, 1, 2, 29, 30, 31, 95])) for k in range(200)]
    got = intervals.grid_stab(spark.createDataFrame(items, "id long, x long, length long"), 30, "m").collect()
    assert sorted((g.id, g.m) for g in got) == sorted((k, m) for k, x, n in items for m in range(-300, 400, 30) if x <= m < x + n)


def test_new_items_of_one_key_and_place(spark, tmp_path):
    """A customer's orders of one day, of which several bring a new item."""
    o = spark.range(64).select(F.col("id").alias("o_orderkey"), (F.col("id") % 2).alias("o_custkey"), F.expr("timestamp '1995-03-05 00:00:00'").alias("o_orderdate"))
    o.repartition(4).write.parquet(str(tmp_path / "orders.parquet"))
    same_as_sql(spark, tmp_path, "sorted_edits")


def test_a_project_file_is_whole_when_its_rows_are_dealt_anew(spark, tmp_path):
    """Partitions that are joined by their sizes, as those of large tables are."""
    spark.range(4_000).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey")).write.parquet(str(tmp_path / "customer.parquet"))
    small = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.shuffle.partitions": "20"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        same_as_sql(spark, tmp_path, "project_files")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("reals", [False, True])
def test_windows_and_stored_items_meet_in_narrow_bins(spark, tmp_path, reals, monkeypatch):
    """All pairs, each once; and the bins they meet in are as narrow as the windows, however wide the folders."""
    r = random.Random(6)
    v = (lambda x: x + r.choice([0.0, 0.25])) if reals else (lambda x: x)
    items = [(k, v(r.randint(-300, 3000)), v(r.choice([1, 2, 15, 16, 17, 90, 700]))) for k in range(150)]
    windows = [(k, (a := v(r.randint(-300, 3000))), a + r.choice([0, 1, 30, 33, 500])) for k in range(60)]
    kind = "double" if reals else "long"
    path = str(tmp_path / "items")
    binned.write_binned(spark.createDataFrame(items, f"id long, x {kind}, length {kind}"), path, 4096)
    met = []
    own = binned.stab_join
    monkeypatch.setattr(binned, "stab_join", lambda *a, **k: met.append(k["width"]) or own(*a, **k))
    got = binned.join_windows(spark, path, 4096, spark.createDataFrame(windows, f"w long, lo {kind}, hi {kind}")).collect()
    want = sorted((w, a, b, k, x, n) for w, a, b in windows for k, x, n in items if a < b and x < b and x + n > a)
    assert sorted((g.w, g.lo, g.hi, g.id, g.x, g.length) for g in got) == want
    assert met and max(met) <= 16


def test_placement_sorts_once_a_direction(spark):
    """Items and movers are sorted down and up for each of the two looks, and not again for what follows."""
    s = spark.range(40).select((F.col("id") % 4).alias("seq"), F.floor(F.col("id") / 4).alias("idx"), F.lit(10).cast("long").alias("length"), F.lit(0).cast("long").alias("transition_length"))
    m = s.where("idx = 0").withColumn("length", F.lit(5).cast("long"))
    out = placement.place(s, m, s.select("seq").distinct().withColumn("x", F.lit(100).cast("long")))[0]
    assert out.count() == 44 and out.where("idx = 10 and length = 5 and transition_length = 0").count() == 4
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 15  # 17 when an order was not seen to be there


def test_placement_shuffles_by_sequence_alone(spark):
    """Items and movers meet by sequence, without a join; where each begins may be in the movers' rows."""
    s = spark.range(60).select((F.col("id") % 5).alias("seq"), F.floor(F.col("id") / 5).alias("idx"), F.lit(10).cast("long").alias("length"), F.lit(-30).cast("long").alias("transition_length"))
    own = s.where("idx % 4 = 1").select("seq", F.col("idx").alias("mover"), (40 * F.col("idx") + 15).alias("x"))
    rows = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("idx"), F.lit(9).cast("long").alias("length"), F.lit(x).cast("long").alias("transition_length")) for i, x in ((0, 0), (1, 4), (2, 3))]))
    movers = own.select("*", rows.alias("r")).select("seq", "r.*", "mover", "x")
    apart, within = placement.place_all(s, movers.drop("x"), own)[0], placement.place_all(s, movers, None)[0]
    got = sorted(map(tuple, apart.collect()))
    assert len(got) == 60 + 5 * 9 and got == sorted(map(tuple, within.collect()))
    assert [(i, n, t) for q, i, n, t in got if q == 0][:6] == [(0, 10, -30), (1, 10, -30), (2, 9, -5), (3, 9, 4), (4, 9, 3), (5, 10, -5)]
    for out in (apart, within):
        plan = out.select("*")._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange ") <= 2  # of items, and of movers with their places


def test_sequences_of_lines_are_shuffled_once(spark):
    """What follows within a sequence finds its rows where they are, in as many tasks as there are partitions."""
    s = queries.lines(spark, "/root/testdata/sf0.001", spread=True)
    own = s.groupBy("seq").agg(F.max("idx").alias("top"))
    assert own._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert s.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_maps_of_many_short_lists_come_from_few_calls(spark, monkeypatch):
    """Lists of a splice or two, one without a key and one that spans batches; lists without marks get no map."""
    r = random.Random(7)
    splices = [(k if k else None, s, *sorted((r.randint(0, 30), r.randint(0, 30))), r.randint(0, 9)) for k in range(300) for s in range(60 if k == 150 else 1 + k % 2)]
    m = [(i, r.choice(range(3, 300, 3)), r.randint(0, 40), r.random() < 0.5) for i in range(900)]
    got = []
    monkeypatch.setattr(marks, "composed", lambda s, keys, f=marks.composed: got.append(f(s, keys)) or got[0])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")
    try:
        out = marks.shift_marks(
            spark.createDataFrame(m, "id long, k long, index long, left_gravity boolean"), spark.createDataFrame(splices, "k long, step long, start long, stop long, new_length long"), ["k"]
        ).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for i, k, x, left in m:
        for _, _, a, b, n in sorted((s for s in splices if s[0] == k), key=lambda s: s[1]):
            x = x if x < a else (a if left else a + n) if x <= b else x + n - (b - a)
        want[i] = x
    assert {o.id: o["index"] for o in out} == want
    assert {g.k for g in got[0].select("k").collect()} <= {k for _, k, _, _ in m}
    assert "FlatMapGroupsInPandas" not in got[0]._jdf.queryExecution().toString()


def test_a_task_sorts_items_once_to_move_them(spark):
    d = spark.range(40).select((F.col("id") % 4).alias("seq"), F.col("id").alias("idx"), F.lit(9).cast("long").alias("length"), F.lit(2).cast("long").alias("transition_length"))
    plan = placement.move_all(d, F.col("idx") % 3 == 0, F.lit(3).cast("long"), strict=False)[0]._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") >= 3
    executed = placement.move_all(d, F.col("idx") % 3 == 0, F.lit(3).cast("long"), strict=False)[0]._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Sort [") == 1
