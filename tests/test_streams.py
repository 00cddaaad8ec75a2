"""Streams that are stopped and go on from their checkpoints, against batch results and plain folds."""

import random
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from cuespan.streaming import clocks, playback

T0 = datetime(2024, 1, 1)


def rows_of(seed, n=400):
    r, rows = random.Random(seed), []
    for k in range(n):
        command = r.choice([None] * 8 + ["play", "stop", "seek"])
        packet = command is None
        rows.append((r.randrange(5), T0 + timedelta(milliseconds=100 * k + r.randrange(100)), k, command, r.randrange(10**10) if command == "seek" else None, r.choice([-3, -1, 1, 2]) if command == "play" else None, r.choice([1, 3]) if command == "play" else None, r.randrange(-(10**9), 10**10) if packet else None, r.choice([-1, 1]) * r.randrange(10**8) if packet else None, r.randrange(2000) if packet else None))
    return rows


def fold(rows):
    out, held = {}, {}
    cut = lambda a, b: a // b if (a < 0) == (b < 0) else -(-a // b)
    for c, at, seq, command, seek_ns, pn, pd, time_ns, duration, samples in sorted(rows, key=lambda x: (x[1], x[2])):
        us = (at - T0) // timedelta(microseconds=1)
        base, seek, n, d, sample, last = held.get(c, (0, 0, 0, 1, 0, 0))
        now = seek + (cut((us - base) * 1000 * n, d) if n else 0)
        if command is None:
            out[seq] = (c, sample, now, time_ns < now + last if n > 0 else time_ns > now - last if n < 0 else False)
            held[c] = (base, seek, n, d, sample + samples, abs(duration))
        else:
            held[c] = (us, seek_ns if command == "seek" else now, *((pn, pd) if command == "play" else (0, 1) if command == "stop" else (n, d)), sample, last)
    return out


def shown(df):
    return {r.seq: (r.channel, r.sample, r.now_ns, r.late) for r in df.collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_played_is_the_fold(spark, seed):
    rows = rows_of(seed)
    got = shown(playback.played(spark.createDataFrame(rows, playback.ROWS).repartition(3)))
    assert got == fold(rows) and any(x[3] for x in got.values()) and playback.played(spark.createDataFrame([], playback.ROWS)).count() == 0


def test_a_stream_that_is_stopped_gives_the_batch_result(spark, tmp_path):
    rows = rows_of(2)
    end = [(99, T0 + timedelta(hours=1), 10**6, "stop", None, None, None, None, None, None)]
    mixed = list(rows)
    r = random.Random(3)
    for k in range(0, len(mixed) - 20, 20):  # out of order, within the two seconds that rows may be late
        part = mixed[k : k + 20]
        r.shuffle(part)
        mixed[k : k + 20] = part
    drops = [mixed[:150], mixed[150:290], mixed[290:] + end]
    saved = {k: spark.conf.get(k, None) for k in (*playback.STATE_STORE, "spark.sql.shuffle.partitions")}
    for k, v in {**playback.STATE_STORE, "spark.sql.shuffle.partitions": "2"}.items():
        spark.conf.set(k, v)
    try:
        steps = []
        for k, drop in enumerate(drops):  # each drop is another run of the query, which goes on from its checkpoint
            spark.createDataFrame(drop, playback.ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            s = playback.play_stream(spark.readStream.schema(playback.ROWS).parquet(f"{tmp_path}/in"), "2 seconds")
            q = s.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
            q.awaitTermination()
            steps.append(spark.read.schema(playback.SHOWN).parquet(f"{tmp_path}/out").count())
        got = spark.read.schema(playback.SHOWN).parquet(f"{tmp_path}/out")
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert steps[0] < steps[1] < steps[2] == len(fold(rows)) == got.count()
    assert shown(got) == fold(rows) == shown(playback.played(spark.createDataFrame(rows, playback.ROWS)))


@pytest.mark.parametrize("kind", ["tumbling", "changes"])
def test_windows_of_a_stream_that_is_stopped(spark, tmp_path, kind):
    r = random.Random(6)
    schema = "at timestamp, stream_id int, lo long, hi long, v double"
    rows = [(T0 + timedelta(milliseconds=400 * k + r.randrange(700)), r.randrange(3), lo := r.randrange(500), lo + r.randrange(40), float(r.randrange(9))) for k in range(200)]
    of = (lambda df: clocks.tumbling(df, "at", "5 seconds", "2 seconds", ["stream_id"], "v")) if kind == "tumbling" else (lambda df: clocks.changes(df, "at", "2 seconds"))
    end = (T0 + timedelta(hours=1), 0, 0, 0, 0.0)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for k, drop in enumerate([rows[:70], rows[70:130], [*rows[130:], end]]):
            spark.createDataFrame(drop, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            s = of(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
            s.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = sorted(tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    whole = of(spark.createDataFrame(rows, schema)).withColumn("window", F.col("window"))
    assert got == sorted(tuple(x) for x in whole.collect()) and len(got) > 20
