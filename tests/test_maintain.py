"""Tables by range and composites that follow edits, against whole reads and whole computations."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from cuespan.sources import binned
from cuespan.streaming import maintain

ITEMS = "id long, x long, length long, v long"


def items_of(seed, n=300, span=5000):
    r = random.Random(seed)
    return [(k, r.randint(-span, span), r.choice([1, 3, 20, 90, 400, 3000]), r.randint(-9, 9)) for k in range(n)]


def spoil(paths):
    for p in paths:
        with open(p, "wb") as f:
            f.write(b"not a parquet file")


@pytest.mark.parametrize(("lo", "hi"), [(-200, -100), (0, 1), (1000, 1500), (9000, 9100)])
def test_a_window_reads_its_own_files(spark, tmp_path, lo, hi):
    rows = items_of(1)
    df, path = spark.createDataFrame(rows, ITEMS), str(tmp_path / "t")
    binned.write_binned(df, path, 64)
    want = sorted(r for r in rows if r[1] < hi and r[1] + r[2] > lo)
    assert sorted(map(tuple, binned.read_window(spark, path, 64, lo, hi).select("id", "x", "length", "v").collect())) == want
    # files outside the window's bins can't even be read
    files = glob.glob(f"{path}/*/*/*.parquet")
    level = lambda p: (int(p.split("level=")[1].split("/")[0]), int(p.split("bin=")[1].split("/")[0]))
    out = [p for p in files if not (lo // (64 * 8 ** level(p)[0]) - 1 <= level(p)[1] <= (hi - 1) // (64 * 8 ** level(p)[0]))]
    assert len(out) > len(files) // 2
    schema = spark.read.parquet(path).schema
    spoil(out)
    own = spark.read.schema(schema)
    assert sorted(map(tuple, binned.read_window(type("S", (), {"read": own})(), path, 64, lo, hi).select("id", "x", "length", "v").collect())) == want


def test_windows_prune_the_join(spark, tmp_path):
    rows = items_of(2)
    path = str(tmp_path / "t")
    binned.write_binned(spark.createDataFrame(rows, ITEMS), path, 64)
    windows = [(k, lo, lo + n) for k, (lo, n) in enumerate([(-300, 40), (100, 1), (105, 300), (0, 0)])]
    out = binned.join_windows(spark, path, 64, spark.createDataFrame(windows, "w long, lo long, hi long"))
    assert sorted((r.w, r.id) for r in out.collect()) == sorted((k, r[0]) for k, lo, hi in windows for r in rows if r[1] < hi and r[1] + r[2] > lo and lo < hi)
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="an item has a length"):
        binned.write_binned(spark.createDataFrame([(1, 0, 0, 0)], ITEMS), str(tmp_path / "no"), 64)


def plain(rows):
    out = {}
    for _, x, n, v in rows:
        for f in range(x, x + n):
            out[f] = out.get(f, 0) + v
    return out


def test_refreshes_are_whole_computations(spark, tmp_path):
    r = random.Random(5)
    rows, path = items_of(3, 80, 2000), str(tmp_path / "c")
    df = spark.createDataFrame(rows, ITEMS)
    everything = spark.createDataFrame([(-20_000, 20_000)], "lo long, hi long")
    maintain.refresh(everything, path, lambda ranges: maintain.mixed(df, ranges), 1, 100)
    assert {x.frame: x.v for x in maintain.current(spark, path).collect()} == plain(rows)
    for gen in (2, 3, 4):
        new = [x if r.random() < 0.96 else (x[0], x[1] + r.randint(-50, 50), r.choice([1, 30]), r.randint(-9, 9)) for x in rows if r.random() < 0.99]
        after = spark.createDataFrame(new, ITEMS)
        edits = maintain.changed(df, after, "id")
        asked = []

        def compose(ranges, after=after, asked=asked):
            asked.append({x.bin for x in ranges.collect()})
            return maintain.mixed(after, ranges)

        # broken off before its list of bins is written, a refresh has no effect; run again, it replaces itself
        before = {x.frame: x.v for x in maintain.current(spark, path).collect()}
        maintain.mixed(after, maintain.dirty_bins(edits, 100)).limit(7).withColumn("bin", F.lit(0)).write.partitionBy("bin").parquet(f"{path}/data/gen={gen}")
        assert {x.frame: x.v for x in maintain.current(spark, path).collect()} == before
        for _ in range(2):
            maintain.refresh(edits, path, compose, gen, 100)
        assert {x.frame: x.v for x in maintain.current(spark, path).collect()} == plain(new)
        touched = {f // 100 for a, b in [(set(rows), set(new)), (set(new), set(rows))] for x in a - b for f in range(x[1], x[1] + x[2])}
        assert asked == [touched] * 2 and len(touched) < 200
        rows, df = new, after


def test_a_stream_of_changes_goes_on_from_its_checkpoint(spark, tmp_path):
    rows, path = items_of(4, 40, 1000), str(tmp_path / "c")
    state = {"items": spark.createDataFrame(rows, ITEMS)}
    maintain.refresh(spark.createDataFrame([(-9000, 9000)], "lo long, hi long"), path, lambda ranges: maintain.mixed(state["items"], ranges), 0, 50)
    for k in range(2):
        new = [(i, x + 7 * (i % 10 == k), n, v) for i, x, n, v in rows]
        after = spark.createDataFrame(new, ITEMS)
        maintain.changed(state["items"], after, "id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        state["items"], rows = after, new
        s = spark.readStream.schema("lo long, hi long").parquet(f"{tmp_path}/in")
        q = maintain.follow(s, path, lambda ranges: maintain.mixed(state["items"], ranges), 50).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        assert {x.frame: x.v for x in maintain.current(spark, path).collect()} == plain(new)
