"""Many movers at once against putting them in one by one."""

import random

import pytest
from pyspark.sql import functions as F

from cuespan.operators import placement


class NoRoom(Exception):
    pass


def put_one(seq, x0, run, x):
    """A list of [length, transition, name] with a run put in at x; x0 is where the list begins."""
    starts, at = [], x0
    for k, (n, t, _) in enumerate(seq):
        at = x0 if k == 0 else at - t
        starts.append(at)
        at += n
    size = sum(n for n, _, _ in run) - sum(t for _, t, _ in run[1:])
    fade_in = run[0][0] - (run[1][1] if len(run) > 1 else 0)
    fade_out = run[-1][0] - (run[-1][1] if len(run) > 1 else 0)
    own = lambda k: max(0, seq[k][1]) if k > 0 else 0
    for i in range(len(seq) + 1):
        if i < len(seq):
            n, t, _ = seq[i]
            if i > 0 and t > 0:
                continue
            hi = starts[i] - size + min(fade_out, n - (seq[i + 1][1] if i + 1 < len(seq) else 0))
            lo = None if i == 0 else max(starts[i - 1] + own(i - 1), starts[i] + min(0, t) - fade_in)
        else:
            hi, lo = None, max(starts[-1] + own(i - 1), starts[-1] + seq[-1][0] - fade_in)
        if (lo is None or x >= lo) and (hi is None or x <= hi):
            ends = starts[i - 1] + seq[i - 1][0] if i else None
            new = [[run[0][0], 0 if i == 0 else ends - x, run[0][2]], *map(list, run[1:])]
            tail = [list(y) for y in seq[i:]]
            if tail:
                tail[0][1] = x + size - starts[i]
            return [*map(list, seq[:i]), *new, *tail], x if i == 0 else x0
    raise NoRoom


def random_run(r, name, most=3):
    run = [[r.randint(1, 12), 0, f"{name}.0"]]
    for k in range(1, r.randint(1, most)):
        n = r.randint(2, 12)
        run.append([n, r.randint(1, min(n, run[-1][0])), f"{name}.{k}"])
    return run


def tables(spark, cases):
    items = [(s, k, n, t, name) for s, (seq, _) in enumerate(cases) for k, (n, t, name) in enumerate(seq)]
    rows = [(s, k, n, t, name, m) for s, (_, movers) in enumerate(cases) for m, (run, _) in enumerate(movers) for k, (n, t, name) in enumerate(run)]
    at = [(s, m, x) for s, (_, movers) in enumerate(cases) for m, (_, x) in enumerate(movers)]
    cols = "seq long, idx long, length long, transition_length long, name string"
    return spark.createDataFrame(items, cols), spark.createDataFrame(rows, f"{cols}, mover int"), spark.createDataFrame(at, "seq long, mover int, x long")


def test_movers_at_once_are_movers_one_by_one(spark):
    r = random.Random(11)
    cases = []
    for s in range(400):
        seq = [[r.randint(1, 15), r.choice([0, 0, -r.randint(1, 30), -r.randint(1, 9)]), f"i{k}"] for k in range(r.randint(1, 6))]
        for k in range(1, len(seq)):
            if r.random() < 0.3:
                seq[k][1] = r.randint(1, min(seq[k][0], seq[k - 1][0]))
        xs = r.sample(range(-25, 90), r.randint(0, 4))
        cases.append((seq, [(random_run(r, f"m{k}"), x) for k, x in enumerate(xs)]))
    items, movers, at = tables(spark, cases)
    got, shift = placement.place_all(items, movers, at, strict=False)
    by, moved = {}, {x.seq: x["shift"] for x in shift.collect()}
    for row in got.orderBy("seq", "idx").collect():
        by.setdefault(row.seq, []).append([row.length, row.transition_length, row.name])
        assert row.idx == len(by[row.seq]) - 1
    placed = 0
    for s, (seq, own) in enumerate(cases):
        want, x0 = seq, 0
        try:
            for run, x in sorted(own, key=lambda m: m[1]):
                want, x0 = put_one(want, x0, run, x)
            placed += bool(own)
        except NoRoom:
            want, x0 = seq, 0
        assert by[s] == want, (s, seq, own)
        assert moved.get(s, 0) == x0, (s, seq, own)
    assert placed > 60


def test_plan_does_not_grow_and_a_thousand_runs_fit(spark):
    seq = [[5, -95 if k else 0, f"i{k}"] for k in range(1001)]
    items, _, _ = tables(spark, [(seq, [])])

    def other(n):
        return spark.createDataFrame([(0, 2 * k + j, 4, (-94 if k else 0) if j == 0 else 2, f"r{k}.{j}") for k in range(n) for j in range(2)], items.schema)

    at = spark.createDataFrame([(0, 40)], "seq long, x long")
    size = [len(placement.place_sequence(items, other(n), at)._jdf.queryExecution().analyzed().collectLeaves().mkString(" ").split("LogicalRDD")) for n in (1, 3, 1000)]
    assert size[0] == size[1] == size[2] < 20
    out = placement.place_sequence(items, other(1000), at).orderBy("idx").collect()
    assert len(out) == 3001 and [r.name for r in out[:4]] == ["i0", "r0.0", "r0.1", "i1"]
    assert [r.transition_length for r in out[:4]] == [0, -35, 2, -54]
    ends = 0
    for k, r in enumerate(out):  # what was there keeps its times
        ends = ends - (r.transition_length if k else 0) + r.length
        if r.name.startswith("i"):
            assert ends - r.length == 100 * int(r.name[1:])


def test_kinds_and_equal_places(spark):
    seq = [[10, 0, "a"], [10, -50, "b"]]
    items, movers, at = tables(spark, [(seq, [([[5, 0, "m"]], 20), ([[5, 0, "n"]], 20)]), (seq, [([[5, 0, "m"]], 20), ([[5, 0, "n"]], 30)])])
    got, _ = placement.place_all(items, movers, at, strict=False)
    assert {(r.seq, r["count"]) for r in got.groupBy("seq").count().collect()} == {(0, 2), (1, 4)}
    with pytest.raises(Exception, match=placement.NO_ROOM):
        placement.place_all(items, movers, at)[0].collect()
    kinds = lambda df, k: df.withColumn("kind", F.lit(k))
    one, spot = movers.where("mover = 0 and seq = 1").drop("mover"), at.where("mover = 0 and seq = 1").drop("mover")
    assert placement.place(kinds(items, "video"), kinds(one, "video"), spot, kind="kind")[0].count() == 5
    assert placement.place(kinds(items, "video"), kinds(one, "audio"), spot, kind="kind", strict=False)[0].count() == 4
