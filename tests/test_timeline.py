"""Fixtures with known values, and properties against plain loops."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from cuespan.functions import frame as ff
from cuespan.functions import signal as sig
from cuespan.functions import timecode as tc
from cuespan.functions import ebml
from cuespan.operators import asof, catalog, chroma, edits, graph, intervals, mix, nesting, packets, placement, ranges, resample
from cuespan.operators import sequences as seqs
from cuespan.sources import generators, projects
from cuespan.streaming import clocks


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_timecodes(spark):
    df = spark.createDataFrame([(-3,), (108_000,), (1_800,), (17_982,), (107_892,), (107_891,)], "f long")
    got = {r.f: (r.a, r.b, r.c) for r in df.select("f", tc.timecode_text(F.col("f"), 30).alias("a"), tc.drop_frame_text(F.col("f")).alias("b"), tc.drop_frame_frames(tc.drop_frame_text(F.col("f"))).alias("c")).collect()}
    assert got[-3][0] == "-00:00:00:03" and got[108_000][0] == "01:00:00:00"
    assert [got[f][1] for f in (1_800, 17_982, 107_892, 107_891)] == ["00:01:00;02", "00:10:00;00", "01:00:00;00", "00:59:59;29"]
    assert all(got[f][2] == f for f in (1_800, 17_982, 107_892, 107_891))
    assert spark.range(1).select(tc.timecode_frames(F.lit("00:03"), 30).alias("x")).first().x == 3


def test_frame_times(spark):
    df = spark.range(-50, 5000, 7)
    back = df.select("id", tc.time_frame(tc.frame_time(F.col("id"), 30_000, 1_001), 30_000, 1_001).alias("f")).where("id >= 0")
    assert back.where("id <> f").count() == 0
    assert df.select(tc.container_tick(F.lit(441), 44_100, 1_000_000).alias("t")).first().t == 10


def test_keyframes(spark):
    k = spark.createDataFrame([(0.0, 0, 4.0), (1.0, 1, 2.0), (2.0, 1, 6.0)], "frame double, kind int, value double")
    want = {-0.5: 4, 0.75: 4, 1.0: 2, 1.25: 3, 1.5: 4, 1.75: 5, 2.0: 6, 2.5: 6}
    f = spark.createDataFrame([(x,) for x in [2.5, 1.5, -0.5, 0.75, 1.0, 1.25, 1.75, 2.0]], "at double")
    got = {r["at"]: r.interpolated for r in asof.interpolate(f, k, "at").collect()}
    assert got == want
    assert asof.interpolate(f, k.limit(0), "at").where("interpolated <> 0").count() == 0


def test_lerp(spark):
    start, end = [1.0, 2, 3, 4], [-1.0, -2, -3, -4]
    rows = spark.range(5).select("id", ff.lerp(F.col("id"), start, end, 4).alias("v")).collect()
    assert all(r.v == [s - r.id * s / 2 for s in start] for r in rows)
    with pytest.raises(ValueError):
        ff.lerp(F.col("id"), start, end, 0)
    assert spark.range(1).select(ff.as_int(F.lit(-0.5)).alias("a"), ff.as_int(F.lit(2.5)).alias("b")).first()[:] == (-1, 3)


@pytest.mark.parametrize("seed", [0, 1])
def test_interval_joins_are_the_cross_join(spark, seed):
    rnd = random.Random(seed)
    items = [(i, rnd.randint(0, 1000), rnd.choice([0, 1, 2, 30, 100, 5000]), rnd.randint(0, 1)) for i in range(80)]
    points = [(f, k) for f in range(-100, 1100, 13) for k in (0, 1)]
    i = spark.createDataFrame(items, "id long, x long, length long, k long")
    p = spark.createDataFrame(points, "f long, k long")
    got = {(r.f, r.k, r.id) for r in intervals.stab_join(p, i, "f", keys=["k"]).collect()}
    assert got == {(f, k, a) for f, k in points for a, x, n, kk in items if k == kk and x <= f < x + n}
    a = i.select("k", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("length").alias("al"))
    b = i.select("k", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("length").alias("bl"))
    pairs = [(r.a, r.b) for r in intervals.overlap_join(a, b, "ax", "al", "bx", "bl", ["k"]).collect()]
    want = {(m, n) for m, x, l1, k in items for n, y, l2, kk in items if k == kk and l1 and l2 and x < y + l2 and y < x + l1}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def _render(spark, transitions):
    """Red value by output frame of items that show frames 1 to 10, as (frame, own weight sum)."""
    rows = [(0, k, 10, t, 1) for k, t in enumerate(transitions)]
    df = spark.createDataFrame(rows, "seq long, idx long, length long, transition_length long, offset long")
    return [(r.start, r.region_start, r.region_length, r.mid, r.a_offset, r.b_offset) for r in seqs.render_plan(df, ["seq"], "idx", "length", "transition_length", "offset").orderBy("idx").collect()]


def test_sequences(spark):
    assert [r[0] for r in _render(spark, [0, 0, 5])] == [0, 10, 15]
    assert [r[0] for r in _render(spark, [0, 5, 5])] == [0, 5, 10]
    assert [r[0] for r in _render(spark, [0, -5, 5])] == [0, 15, 20]
    plan = _render(spark, [0, 0, 5])
    assert plan[1][1:] == (10, 10, 5, 1, 1 - 5) and plan[2][1:] == (20, 5, 5, 6, None)
    df = spark.createDataFrame([(0, k, 10, t) for k, t in enumerate([0, 0, 5])], "seq long, idx long, length long, t long")
    assert seqs.total_length(df, ["seq"], "idx", "length", "t").first().length == 25
    assert [r.group_no for r in seqs.overlap_groups(df, ["seq"], "idx", "t").orderBy("idx").collect()] == [1, 2, 2]


def test_over_is_the_pairwise_rule(spark):
    rnd = random.Random(4)
    rows = [(f, z, rnd.random(), rnd.choice([0.0, 1.0, rnd.random()])) for f in range(29) for z in range(rnd.randint(1, 5))]
    rows += [(29, z, rnd.random(), rnd.random() / 500) for z in range(2000)]  # an index with most of the rows
    got = {r.f: (r.c, r.a) for r in mix.over(spark.createDataFrame(rows, "f int, z int, c double, a double"), ["f"], ["z"], ["c"], "a").collect()}
    for f in range(30):
        c = a = 0.0
        for _, _, cc, aa in sorted(r for r in rows if r[0] == f):
            out = aa + a * (1 - aa)
            c, a = ((cc * aa + c * a * (1 - aa)) / out, out) if out else (0.0, 0.0)
        assert math.isclose(got[f][0], c, abs_tol=1e-9) and math.isclose(got[f][1], a, abs_tol=1e-9)


def test_audio(spark):
    a = spark.createDataFrame([(s, float(s - 1)) for s in range(1, 6)], "s long, v double")
    b = spark.createDataFrame([(s, float(8 - s)) for s in range(3, 8)], "s long, v double")
    assert [r.v for r in mix.additive(a.unionByName(b), ["s"], "v").orderBy("s").collect()] == [0, 1, 7, 7, 7, 2, 1]
    apart = mix.additive(a.unionByName(ranges.attenuate(b, "s", "v", 1.0, -10)), ["s"], "v")
    assert [r.v for r in ranges.fill(apart, "s", "v").orderBy("s").collect()][5:12] == [0.0] * 7
    assert ranges.attenuate(a, "s", "v", 0).count() == 0
    got = ranges.fetch_samples(a.withColumn("c", F.lit(0)), "s", "c", "v", 0, 2, 2)
    assert values(got.select("s", "c", "v"), "s", "c") == [(0, 0, 0.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 0.0), (2, 0, 1.0), (2, 1, 0.0)]
    w = mix.overwrite(a.withColumn("p", F.lit(0)).unionByName(b.withColumn("p", F.lit(1))), ["s"], "v", F.col("p"))
    assert dict(values(w, "s"))[4] == 4.0
    x = mix.crossfade(a, b, ["s"], "v", F.lit(0.25))
    assert dict(values(x, "s"))[1] == 0.0 and dict(values(x, "s"))[7] == 0.25


def test_pulldown(spark):
    want = {0: [(0, 0), (1, 1), (3, 2), (4, 4)], 1: [(0, 0), (2, 1), (3, 3), (4, 4)], 2: [(1, 0), (2, 2), (3, 3), (4, 4)], 3: [(1, 1), (2, 2), (3, 3), (5, 4)], 4: [(0, 0), (1, 1), (2, 2), (4, 3)]}
    for c, pairs in want.items():
        even, odd = resample.pulldown(F.col("id"), c)
        got = [tuple(r) for r in spark.range(4).orderBy("id").select(even, odd).collect()]
        assert got[:3] == pairs[:3], c
        assert (got[3] == pairs[3]) or c in (1, 2)
    n = spark.range(1).select(*[resample.pulled_length(F.lit(13), c).alias(str(c)) for c in range(5)]).first()
    assert list(n) == [10, 10, 10, 11, 11]


def test_scale_keeps_flat_pictures(spark):
    p = spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"), F.lit(3.0).alias("v"))
    out = resample.scale(p, [], "x", "y", "v", 0.5, 2.0)
    assert out.where("abs(v - 3) > 1e-9").count() == 0 and out.count() > 0
    assert resample.scale(p, [], "x", "y", "v", 0, 1).count() == 0 and resample.scale(p, [], "x", "y", "v", 1, 1).count() == 64
    assert math.isclose(sum(w for _, w in sig.triangle_taps(0.5)), 1) and math.isclose(sum(w for _, w in sig.lanczos_taps(0.5)), 1)


def test_colour(spark):
    df = spark.createDataFrame([(0.2, 0.4, 0.9, 1.0), (0.0, 0.0, 0.0, 0.0)], "r double, g double, b double, a double")
    y, cb, cr = sig.ycbcr(*map(F.col, "rgb"))
    for r in df.select("r", "g", "b", *[c.alias(n) for c, n in zip(sig.rgb(y, cb, cr), "xyz", strict=True)]).collect():
        assert all(math.isclose(p, q, abs_tol=1e-9) for p, q in zip(r[:3], r[3:], strict=True))
    v = df.select(sig.linear_to_rec709(sig.rec709_to_linear(F.col("g"))).alias("g"), sig.argb32(*map(F.col, "rgba")).alias("p")).collect()
    assert math.isclose(v[0].g, 0.4, abs_tol=1e-3) and v[0].p >> 24 == 255 and v[1].p == 0


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, True), (2, 3, False), (3, 1, False), (4, 5, True)], "source long, target long, two boolean")
    r = graph.reach(spark.createDataFrame([(1,), (5,)], "origin long"), graph.both_ways(e, "source", "target", "two"))
    assert {(x.origin, x.node) for x in r.collect()} == {(1, 1), (1, 2), (1, 3), (5, 5), (5, 4)}


def test_long_chains_and_circles(spark):
    one = spark.createDataFrame([(0,)], "origin long")
    chain = spark.range(130).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    r = graph.reach(one, chain.unionByName(spark.createDataFrame([(130, 0)], "source long, target long")))
    assert r.count() == 131 and r.agg(F.max("depth")).first()[0] == 130
    # 1 <- 2 <- 3, a circle of 5, 6 and 7 with 8 behind it, and two items tied both ways
    items = spark.createDataFrame([(i, r) for i, r in [(1, 5), (2, 5), (3, 5), (5, 9), (6, 2), (7, 3), (8, 9), (10, 4), (11, 4)]], "id long, rate long")
    ties = spark.createDataFrame([(2, 1), (3, 2), (5, 6), (6, 7), (7, 5), (8, 5), (10, 11), (11, 10), (3, 99)], "source long, target long")
    d = dict(values(graph.anchor_order(items, ties).select("id", "depth"), "id"))
    assert d[1] < d[2] < d[3] and d[6] < d[5] < d[7] and d[5] < d[8] and d[10] < d[11] and len(d) == 9


def test_one_key_of_many_rows(spark):
    """Each neighbour is found in one pass, however many rows a key has."""
    n = 100_000
    k = spark.range(0, n, 10).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("frame"), F.col("id").cast("double").alias("value"), F.lit(1).alias("kind"))
    f = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("at"))
    assert asof.interpolate(f, k, "at", keys=["k"]).where("at < 99990 and abs(interpolated - at) > 1e-6").count() == 0
    s = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("idx"), F.col("id").alias("v"))
    assert seqs.neighbours(s, ["k"], "idx", "v", F.col("v") % 2 == 1).where("v % 2 = 0 and next <> v + 2").count() == 0


def test_placement(spark):
    """Room in sequences; times of neighbours stay."""
    seq = spark.createDataFrame([(0, 0, 10, 0), (0, 1, 10, -5), (0, 2, 10, 4)], "seq long, idx long, length long, transition_length long")
    new = spark.createDataFrame([(0, 0, 8, 0)], seq.schema)
    at = lambda x: spark.createDataFrame([(0, x)], "seq long, x long")
    starts = lambda d: {(r.length, r.start) for r in seqs.overlap_starts(d, ["seq"], "idx", "length", "transition_length").collect()}
    old = starts(seq)
    assert old == {(10, 0), (10, 15), (10, 21)}
    done, shift = placement.place(seq, new, at(8), strict=False)
    assert starts(done) == old | {(8, 8)} and shift.count() == 0
    done, shift = placement.place(seq, new, at(30))
    assert starts(done) == old | {(8, 30)}
    done, shift = placement.place(seq, new, at(-20))
    assert shift.first().shift == -20 and starts(done) == {(8, 0)} | {(n, x + 20) for n, x in old}
    assert placement.place(seq, new, at(20), strict=False)[0].count() == 3
    with pytest.raises(Exception, match="no room"):
        placement.place(seq, new, at(20))[0].collect()
    two = spark.createDataFrame([(0, 0, 3, 0), (0, 1, 2, -1)], seq.schema)
    assert starts(placement.place_sequence(seq, two, at(40))) == old | {(3, 40), (2, 44)}
    assert starts(placement.place_sequence(seq, two, at(-9))) - {(10, 9), (10, 24), (10, 30)} == {(3, 0), (2, 4)}
    moved, _ = placement.move_all(seq, F.col("idx") > 0, F.lit(-4))
    assert starts(moved) == {(10, 0), (10, 11), (10, 17)}
    with pytest.raises(Exception, match="no room"):
        placement.move_all(seq, F.col("idx") == 2, F.lit(-9))[0].collect()
    kept, _ = placement.move_all(seq, F.col("idx") == 2, F.lit(-9), strict=False)
    assert starts(kept) == old
    clip = spark.createDataFrame([(0, 5, 0, 0.0, 4.0)], "x long, length long, offset long, y double, height double")
    assert placement.adjust_clip(clip, F.lit(True), F.lit(2), "start").first()[:3] == (2, 3, 2)
    for what in ("start", "top"):
        with pytest.raises(Exception, match="no room"):
            placement.adjust_clip(clip, F.lit(True), F.lit(5), what).collect()
    o = seq.withColumn("offset", F.lit(0))
    later, shift = placement.adjust_start(o, F.col("idx") == 0, F.lit(3))
    assert shift.first().shift == 3 and later.orderBy("idx").first().length == 7
    assert starts(placement.adjust_start(o, F.col("idx") == 1, F.lit(2))[0]) == {(10, 0), (8, 17), (10, 21)}
    with pytest.raises(Exception, match="no room"):
        placement.adjust_start(o, F.col("idx") == 1, F.lit(7))[0].collect()
    assert starts(placement.adjust_length(seq, F.col("idx") == 0, F.lit(2))) == {(12, 0), (10, 15), (10, 21)}
    with pytest.raises(Exception, match="no room"):
        placement.adjust_length(seq, F.col("idx") == 1, F.lit(7)).collect()


def test_chroma_planes_keep_grey(spark):
    """A grey picture goes through planes and back."""
    p = spark.range(128).select(F.lit(0).alias("frame"), (F.floor(F.col("id") / 32) - 1).cast("int").alias("y"), (F.col("id") % 32).cast("int").alias("x"), *[F.lit(0.5).alias(c) for c in "rgb"])
    luma, c = chroma.subsample_411(p)
    assert c.count() == 32 and c.where("cb not between 127 and 128").count() == 0
    back = chroma.reconstruct_411(luma, c, 32)
    assert back.count() == 128 and back.where("abs(g - 0.5) > 0.01").count() == 0 and back.agg(F.min("y")).first()[0] == -1
    _, c = chroma.subsample_420_interlaced(p.withColumn("y", F.col("y") + 1), 32, 4)
    assert c.count() == 32 and c.where("abs(cb - 128) > 1e-6").count() == 0


def test_a_space_in_itself(spark):
    rows = [("a", "b", 0, 5, 0, 0), ("b", "a", 0, 5, 0, 0)]
    with pytest.raises(Exception, match="in itself"):
        nesting.flatten(spark.createDataFrame(rows, "space string, source string, x long, length long, offset long, z long"), "a")


def test_numbers_in_bytes(spark):
    n = [0, 1, 126, 127, 16_382, 16_383, 200, 256, -1, -128, -255, 2**40]
    df = spark.createDataFrame([(v,) for v in n], "v long")
    got = {r.v: bytes(r.i) for r in df.select("v", ebml.encode_int(F.col("v")).alias("i")).collect()}
    for v in n:
        raw = v.to_bytes(v.bit_length() // 8 + 1, "big", signed=True)
        assert got[v] == (raw[1:] if v > 0 and raw[0] == 0 else raw)
    size = {r.v: bytes(r.s).hex() for r in df.where("v >= 0").select("v", ebml.encode_size(F.col("v")).alias("s")).collect()}
    assert (size[0], size[126], size[127], size[16_382], size[16_383]) == ("80", "fe", "407f", "7ffe", "203fff")
    assert len(ebml.make_void(100)) == 100 and ebml.make_void(0) == b""


def test_large_times(spark):
    """Frames and nanoseconds beyond what a product of all numbers would hold."""
    f = 10**9 + 7
    r = spark.range(1).select(tc.frame_time(F.lit(f), 30_000, 1_001).alias("t"), tc.time_frame(tc.frame_time(F.lit(f), 30_000, 1_001), 30_000, 1_001).alias("f")).first()
    assert r.t == f * 1_001 * 10**9 // 30_000 + 1 and r.f == f


def test_edits(spark):
    rows = [(0, k, 10 + k, 0, t) for k, t in enumerate([0, 3, -2, 5, 0])]
    t0 = spark.createDataFrame(rows, "seq long, idx long, length long, offset long, transition_length long")
    start = lambda t: {r.length: r.start for r in seqs.overlap_starts(t, ["seq"], "idx", "length", "transition_length").collect()}
    cut = edits.remove(t0, F.col("idx").isin(1, 2))
    shift = start(t0)[10] - start(cut)[10]
    assert all(start(t0)[k] == start(cut)[k] + shift for k in start(cut))
    key = ["seq", "idx"]
    back = edits.replay(cut.select(*t0.columns), edits.log(t0, cut.select(*t0.columns), key, 1), key, undo=True)
    assert values(back.select(*t0.columns), "idx") == rows
    moved = start(edits.move_in_place(t0, F.col("idx") == 2, F.lit(4)))
    assert moved[12] == start(t0)[12] + 4 and all(moved[k] == v for k, v in start(t0).items() if k != 12)
    z = spark.createDataFrame([(i, 0, x, 10, 0.0, 1.0, i) for i, x in enumerate([0, 100, 5, 200, 8])], "id long, k long, x long, length long, y double, height double, z long")
    stack = lambda i, back=False: {r.id: r.z for r in edits.restack(z, F.col("id") == i, ["k"], back).collect()}
    assert stack(4) == {0: 0, 1: 1, 4: 2, 2: 3, 3: 4} and stack(2) == {2: 0, 0: 1, 1: 2, 3: 3, 4: 4} and stack(1) == {i: i for i in range(5)}
    assert stack(0, True) == {1: 0, 0: 2, 2: 1, 3: 3, 4: 4} and stack(2, True) == {0: 0, 1: 1, 3: 2, 4: 3, 2: 4}
    new = spark.createDataFrame([(0, 1, 99, 0, 0)], t0.schema)
    assert [r.length for r in edits.insert(t0, new).orderBy("idx").collect()] == [10, 99, 11, 12, 13, 14]


def test_catalog_and_packets(spark):
    p = spark.createDataFrame([(0, 0, None, 0, True), (0, 1, 10, 5, False), (0, 2, 20, 9, True), (1, 3, 1, 1, True)], "stream_id int, seq long, pts long, dts long, keyframe boolean")
    d = packets.demux(p, 0, 2, 1)
    assert values(d.select("seq", "pts"), "seq") == [(0, 0), (1, 5), (2, 10)]
    assert [r.seq for r in packets.seek(d, 12).collect()] == [2] and packets.seek(d, -1).count() == 0
    s = spark.createDataFrame([("a", 0, 5, 9), ("a", 1, None, None)], "asset_path string, stream_no int, range_min int, range_max int")
    assert values(catalog.drop_clip(s, 100, 50).select("stream_no", "x", "length", "anchor_to"), "stream_no") == [(0, 105, 5, None), (1, 100, 50, 0)]


def test_sources(spark, tmp_path):
    f = spark.createDataFrame([(0,), (1,)], "frame long")
    c = ff.lerp(F.col("frame"), [0.5, 0.25, 2, 1], [-0.5, -0.25, -2, 0], 2)
    s = generators.solid(f, c, (0, 0), (1, 1))
    assert s.count() == 8 and s.where("frame = 1 and (r <> 0 or a <> 0.5)").count() == 0
    still = generators.still(f, s.where("frame = 0").drop("frame"), (0, 0), (0, 1))
    assert still.count() == 4 and generators.empty(spark).count() == 0
    (tmp_path / "project.json").write_text(json.dumps({"items": [{"id": 1, "source": "a", "length": 5, "anchors": [{"target": 2, "two_way": True}]}, {"id": 2, "x": 3}]}, indent=1))
    p = projects.load_project(spark, f"file://{tmp_path}/project.json")
    assert values(p["clip"], "item_id") == [(1, "video", "a", 0, 0.0, 5, 1.0, 0, 0), (2, "video", None, 3, 0.0, 1, 1.0, 0, 1)]
    assert values(p["anchor"], "source") == [(1, 2, 0, False, True)]
    assert p["clip"].count() == 2 and p["anchor"].count() == 1 and "anchors" in projects.dump_project(p).orderBy("item_id").first().json
    assert projects.pull(s) > 0


def test_stream_of_clock_commands(spark, tmp_path):
    rows = [("d", 0, "play", 0, 1, 3), ("d", 2**60 + 1, "stop", 0, 0, 1), ("c", 0, "play", 0, 1, 1), ("c", 10, "stop", 0, 0, 1), ("c", 20, "play", 0, -1, 2), ("c", 30, "seek", 200, 0, 1), ("c", 40, "stop", 0, 0, 1)]
    schema = "clock_id string, at_ns bigint, command string, seek_ns bigint, n bigint, d bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = clocks.clock(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("clock").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.time_ns for r in spark.table("clock").where("clock_id = 'c'").orderBy("at_ns").collect()] == [0, 10, 10, 200, 195]
    assert [r.time_ns for r in spark.table("clock").where("clock_id = 'd'").orderBy("at_ns").collect()] == [0, (2**60 + 1) // 3]
