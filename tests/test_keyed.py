"""Edits by key, project files, points of a scaled picture and values of four parts, against plain versions."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from cuespan.functions import timecode as tc
from cuespan.operators import asof, ranges, resample
from cuespan.operators import sequences as seqs
from cuespan.sources import projects


def test_sorted_lists_are_those_of_single_edits(spark):
    r = random.Random(3)
    lists = {p: sorted((r.randrange(12), 100 * p + i) for i in range(20)) for p in range(3)}
    rows = [(p, i, k, n) for p, own in lists.items() for n, (k, i) in enumerate(own)]
    edits, new = [], 1000
    for step in range(150):
        p = r.randrange(4)
        own = lists.setdefault(p, [])
        op = r.choice(["add", "remove", "move"]) if own else "add"
        key = r.randrange(12)
        item = None if op == "add" else r.choice(own)[1]
        if op == "add":
            item, new = new, new + 1
        else:
            own[:] = [x for x in own if x[1] != item]
        if op != "remove":
            own.insert(bisect.bisect_left([k for k, _ in own], key), (key, item))
        edits.append((p, step, op, item, None if op == "remove" else key))
    items = spark.createDataFrame(rows, "p int, id long, key int, pos long")
    out = seqs.keyed_edits(items, spark.createDataFrame(edits, "p int, step int, op string, id long, key int"), ["p"], "id", "key").collect()
    got = {p: [(x.key, x.id) for x in sorted((x for x in out if x.p == p), key=lambda x: x.pos)] for p in lists}
    assert got == {p: own for p, own in lists.items()}


def test_workspace_rows_by_key(spark):
    r = random.Random(4)
    state = {i: {"x": r.randrange(9), "tag": "a"} for i in range(10)}
    items = spark.createDataFrame([(i, v["x"], v["tag"]) for i, v in state.items()], "item_id int, x int, tag string")
    edits = []
    for step in range(120):
        i, op = r.randrange(15), r.choice(["add", "remove", "update", "update"])
        if op == "add" and i in state:
            op = "update"
        own = {"x": r.choice([None, r.randrange(9)]), "tag": r.choice([None, "b", "c"])} if op != "remove" else {"x": None, "tag": None}
        own = {"x": own["x"] or 0, "tag": own["tag"]} if op == "add" else own
        edits.append((step, op, i, own["x"], own["tag"]))
        if op == "remove":
            state.pop(i, None)
        elif op == "add":
            state[i] = dict(own)
        elif i in state:
            state[i].update({k: v for k, v in own.items() if v is not None})
    out = seqs.workspace_edits(items, spark.createDataFrame(edits, "step int, op string, item_id int, x int, tag string"))
    assert {x.item_id: {"x": x.x, "tag": x.tag} for x in out.collect()} == state


PROJECT = """
!Project
  assets:
    7b: !PluginSourceAsset {plugin_urn: urn:dv, definition: {path: /a.dv}}
    main: !SpaceAsset
      space: !CanvasSpace
        video_format: !VideoFormat {frame_rate: !rational [25, 1], full_frame: !box2i [!v2i '(0, 0)', !v2i '(99, 49)']}
        items:
        - &A !CanvasClip {source: !AssetStreamRef {asset_path: 7b, stream: "0"}, type: video, length: 100, x: 60, y: 30.0, offset: 9}
        - !CanvasClip {type: audio, length: 7, x: 9, anchor: !CanvasAnchor {target: *A, two_way: true, offset_ns: -5}}
        - !CanvasSequence
          x: 3
          items:
          - !CanvasSequenceItem {source: !AssetStreamRef {asset_path: 7b, stream: "0"}, offset: 0, length: 300}
          - !CanvasSequenceItem {offset: 50, length: 300, transition_length: 48}
"""


def test_project_files_with_links(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.yaml").write_text(PROJECT)
    p = projects.load_projects(spark, f"{tmp_path}/*.yaml")
    assert [tuple(x)[1:] for x in p["asset"].where("project like '%a.yaml'").orderBy("asset").collect()] == [("7b", "PluginSourceAsset", "urn:dv", '{"path": "/a.dv"}'), ("main", "SpaceAsset", None, None)]
    items = [tuple(x)[2:] for x in p["item"].where("project like '%b.yaml'").orderBy("z").collect()]
    assert items == [(0, "CanvasClip", "video", "7b", "0", 60, 30.0, 100, 1.0, 9, 0), (1, "CanvasClip", "audio", None, None, 9, 0.0, 7, 1.0, 0, 1), (2, "CanvasSequence", "video", None, None, 3, 0.0, 552, 1.0, 0, 2)]
    assert {tuple(x)[2:] for x in p["anchor"].collect()} == {(1, 0, -5, False, True)} and p["anchor"].count() == 2
    assert [tuple(x)[2:] for x in p["sequence_item"].where("project like '%a.yaml'").orderBy("idx").collect()] == [(2, 0, "7b", "0", 0, 300, 0), (2, 1, None, None, 50, 300, 48)]
    (tmp_path / "c.yaml").write_text(PROJECT.replace("*A", "!CanvasClip {x: 1}"))
    with pytest.raises(Exception, match="target is not in its space"):
        projects.load_projects(spark, f"{tmp_path}/c.yaml")["anchor"].collect()


def test_points_of_a_scaled_picture(spark):
    df = spark.range(30).select((F.col("id") % 6).cast("int").alias("x"), F.floor(F.col("id") / 6).cast("int").alias("y"), (F.col("id") * 1.5).alias("v"))
    moved = {(r.x, r.y): r.v for r in resample.scale(df, [], "x", "y", "v", 1.0, 1.0, target=(5, -2), source=(1, 1)).collect()}
    assert moved == {(r.x + 4, r.y - 3): r.v for r in df.collect()}
    half = {(r.x, r.y): r.v for r in resample.scale(df, [], "x", "y", "v", 1.0, 1.0, target=(0.5, 0), rect=(0, 0, 5, 0)).collect()}
    assert half[1, 0] == 0.75 and half[0, 0] == 0.0 and {y for _, y in half} == {0}


def test_values_of_up_to_four_parts(spark):
    k = spark.createDataFrame([(0.0, 0, [1.0]), (1.0, 1, [2.0, 4.0]), (3.0, 1, [6.0, 0.0, 1.0, 8.0])], "frame double, kind int, value array<double>")
    f = spark.createDataFrame([(x,) for x in (-1.0, 0.5, 2.0, 9.0)], "at double")
    got = {r["at"]: r.interpolated for r in asof.interpolate(f, k, "at").collect()}
    assert got == {-1.0: [1, 0, 0, 0], 0.5: [1, 0, 0, 0], 2.0: [4, 2, 0.5, 4], 9.0: [6, 0, 1, 8]}
    assert asof.interpolate(f, k.limit(0), "at").first().interpolated == [0, 0, 0, 0]
    for bad in ([], [1.0] * 5):
        with pytest.raises(Exception, match="one to four parts"):
            asof.interpolate(f, spark.createDataFrame([(0.0, 0, bad)], k.schema), "at").collect()


def test_speeds(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(10)], "k int, s int, v double")
    out = lambda *a: [x.v for x in ranges.varispeed(df, ["k"], "s", "v", *a).orderBy("s").collect()]
    assert out(8, 4, 1, 1) == [8, 9, 0, 0] and out(0, 5, 3, 2) == [0, 1, 3, 4, 6] and out(0, 5, -3, 2) == [6, 4, 3, 1, 0] and out(-2, 3, 1, 1) == [0, 0, 0]
    n = 5 * 24 * 3600 * 10**9  # five days
    assert spark.range(1).select(tc.clock_time(F.lit(n + 7), F.lit(0), F.lit(1), F.lit(30_000), F.lit(1001)).alias("t")).first().t == 1 + (n + 7) * 30_000 // 1001
    assert spark.range(1).select(tc.clock_time(F.lit(10), F.lit(0), F.lit(0), F.lit(-1), F.lit(3)).alias("t")).first().t == -3
