"""The container as a data source: round trips, ranges, cues, and what failed tasks leave."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cuespan.sources import container


@pytest.fixture(scope="module")
def source(spark):
    container.register(spark)
    return spark


def packets(spark, n=3000):
    r = random.Random(2)
    rows = [(1 + k % 2, k * 40 + r.randint(-30, 30) + 30, r.random() < 0.1, False, k % 7 == 0, bytes(r.randrange(256) for _ in range(r.choice([0, 1, 5, 130, 300])))) for k in range(n)]
    return spark.createDataFrame(rows, container.PACKETS), rows


def files(path):
    return sorted(os.listdir(path))


def test_round_trip_ranges_and_cues(source, tmp_path):
    df, rows = packets(source)
    path = f"{tmp_path}/out"
    own = df.repartitionByRange(3, "pts").sortWithinPartitions("pts", "track")
    own.write.format("container").mode("append").option("cluster", 5000).option("split", 20_000).option("tags", '{"TITLE": "täst"}').save(path)
    back = source.read.format("container").load(path)
    assert sorted(tuple(r)[:5] + (bytes(r.data),) for r in back.collect()) == sorted(rows)
    assert back.rdd.getNumPartitions() > 6  # ranges, not files
    some = back.where("pts >= 50000 and pts < 52000")
    assert some.rdd.getNumPartitions() <= 2 and some.count() == sum(50000 <= r[1] < 52000 for r in rows)
    assert {x.rsplit(".", 1)[1] for x in files(path)} == {"mkv", "json"} and len(files(path)) == 4
    cues = source.read.format("container").option("table", "cues").load(path).collect()
    assert sorted(c.time for c in cues) == sorted(r[1] for r in rows if r[2] and r[0] == 1)
    one = max(cues, key=lambda c: c.time)
    raw = open(f"{path}/{one.file}", "rb").read()
    segment = raw.index(container.mark_bytes(container.SEGMENT)) + 12
    assert raw[segment + one.position :].startswith(container.mark_bytes(container.CLUSTER_MARK))
    assert {(t.track, t.kind) for t in source.read.format("container").option("table", "tracks").load(path).collect()} == {(1, 1), (2, 2)}
    assert {(t.name, t.value) for t in source.read.format("container").option("table", "tags").load(path).collect()} == {("TITLE", "täst")}
    # a file alone, and files without an index
    assert source.read.format("container").load(f"{path}/{one.file}").count() > 0
    os.remove(next(f"{path}/{x}" for x in files(path) if x.startswith("_index")))
    assert source.read.format("container").load(path).count() == len(rows)


def test_append_and_overwrite(source, tmp_path):
    df, rows = packets(source, 50)
    path = f"file://{tmp_path}/out"
    for _ in range(2):
        df.coalesce(1).sortWithinPartitions("pts").write.format("container").mode("append").save(path)
    assert source.read.format("container").load(path).count() == 100
    df.limit(20).coalesce(1).write.format("container").mode("overwrite").save(path)
    assert source.read.format("container").load(path).count() == 20 and len(files(tmp_path / "out")) == 2
    df.limit(0).write.format("container").mode("overwrite").save(path)
    assert source.read.format("container").load(path).count() == 0


def test_a_failed_task_leaves_nothing(source, tmp_path):
    df, _ = packets(source, 200)
    path = f"{tmp_path}/out"
    df.coalesce(1).write.format("container").mode("append").save(path)
    before = files(path)
    late = F.when(F.col("pts") > 6000, F.raise_error(F.lit("late"))).otherwise(F.col("pts"))
    with pytest.raises(Exception, match="late"):
        df.repartitionByRange(4, "pts").withColumn("pts", late.cast("long")).write.format("container").mode("append").save(path)
    with pytest.raises(Exception, match="not negative"):
        df.withColumn("pts", -F.col("pts")).write.format("container").mode("append").save(path)
    assert files(path) == before and source.read.format("container").load(path).count() == 200


def test_clusters_are_those_of_the_rules(source, tmp_path):
    rows = [(1, t, True, False, False, b"x" * 10) for t in (0, 100, 32767, 32768, 40000, 70000, 70001)]
    source.createDataFrame(rows, container.PACKETS).coalesce(1).write.format("container").mode("append").option("split", 1).save(f"{tmp_path}/out")
    d = source.read.format("container").load(f"{tmp_path}/out").withColumn("part", F.spark_partition_id())
    assert sorted(r.n for r in d.groupBy("part").agg(F.sort_array(F.collect_list("pts")).alias("n")).collect()) == [[0, 100, 32767], [32768, 40000], [70000, 70001]]
