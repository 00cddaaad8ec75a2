"""Long logs, many splices of one list, and orders of stacks, against folds."""

import random

import numpy as np
from pyspark.sql import functions as F

from cuespan.operators import edits, graph, marks


def plain_mark(i, left, splices):
    for a, b, n in splices:
        i = i if i < a else (a if left else a + n) if i <= b else i + n - (b - a)
    return i


def random_splices(r, n, span):
    out = []
    for _ in range(n):
        a = r.randrange(span)
        out.append((a, a + r.choice([0, 0, 1, 5, 40]), r.choice([0, 1, 3, 30])))
    return out


def test_maps_compose(monkeypatch):
    r = random.Random(1)
    for _ in range(40):
        splices = random_splices(r, r.randint(1, 30), 200)
        for left in (True, False):
            lo, one, by = marks._all([marks.splice_map(*s, left) for s in splices])
            x = np.arange(-3, 400)
            k = np.searchsorted(lo, x, side="right") - 1
            assert np.where(one[k], by[k], x + by[k]).tolist() == [plain_mark(int(i), left, splices) for i in x]


def test_a_hundred_thousand_splices_of_one_list(spark):
    r = random.Random(2)
    splices = random_splices(r, 100_000, 1_000_000)
    s = spark.createDataFrame([(0, k, *x) for k, x in enumerate(splices)] + [(1, 0, 5, 6, 9)], "l int, step long, start long, stop long, new_length long")
    own = [(0, r.randrange(1_500_000), r.random() < 0.5, k) for k in range(60)] + [(1, 5, False, 60), (1, 7, True, 61), (2, 3, True, 62)]
    got = {x.k: x["index"] for x in marks.shift_marks(spark.createDataFrame(own, "l int, index long, left_gravity boolean, k int"), s, ["l"]).collect()}
    want = {k: plain_mark(i, left, splices if l == 0 else [(5, 6, 9)] if l else []) for l, i, left, k in own if l < 2} | {62: 3}
    assert got == want


def test_a_compacted_log_replays_and_undoes_as_the_whole_one(spark):
    r = random.Random(3)
    state = {k: r.randrange(9) for k in range(30)}
    steps, entries, at = [], [], {0: dict(state)}
    for step in range(1, 41):
        steps.append((step, r.choice(["move", "move", "trim"]), r.random() < 0.8))
        for k in r.sample(range(40), 5):
            new = r.choice([None, r.randrange(4)])
            if state.get(k) != new:
                entries.append((step, k, None if k not in state else (state[k],), None if new is None else (new,)))
                state.pop(k, None) if new is None else state.update({k: new})
        at[step] = dict(state)
    log = spark.createDataFrame(entries, "step int, k long, before struct<v: int>, after struct<v: int>")
    run = edits.runs(spark.createDataFrame(steps, "step int, kind string, merges boolean"))
    named = {x.step: x.run for x in run.collect()}
    want, last = {}, None
    for step, kind, merges in steps:
        want[step] = want[step - 1] if last and merges and last == (kind, True) else step
        last = (kind, merges)
    assert named == want
    short = edits.compact(log, run, ["k"])
    assert short.count() < log.count() and set(x.step for x in short.select("step").distinct().collect()) <= set(named.values())
    table = lambda x: spark.createDataFrame([*x.items()], "k long, v int")
    for entries in (log, short):
        assert dict(map(tuple, edits.replay_all(table(at[0]), entries, ["k"]).collect())) == at[40]
        assert dict(map(tuple, edits.replay_all(table(at[40]), entries, ["k"], undo=True).collect())) == at[0]
    now = table(at[40])
    for first in sorted(set(named.values()), reverse=True)[:6]:  # taken back run by run
        now = graph.fresh(edits.replay(now, short.where(F.col("step") == first), ["k"], undo=True))
        assert dict(map(tuple, now.collect())) == at[first - 1]


def test_stacks_are_painted_by_z_and_others_by_y(spark):
    items = spark.createDataFrame([(1, 0, 5), (2, 9, 1), (3, 5, 9), (4, 7, 2), (5, 5, 9), (6, 1, 0), (7, 3, 0)], "id long, y int, z int")
    laps = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2), (6, 7), (7, 6)], "a long, b long")
    got = [x.id for x in graph.stack_order(items, laps).orderBy("paint").collect()]
    # 2 has the greatest y, but lies under 1 and 3; 6 and 7 overlap at one z; 4 and 5 alone
    assert got == [3, 1, 2, 4, 5, 7, 6]
    assert graph.stack_order(items.limit(0), laps.limit(0)).count() == 0
