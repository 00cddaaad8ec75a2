"""One query for each operator, on the star-schema and event tables, with the same query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import frame as ff
from ..functions import geometry as geo
from ..functions import signal as sig
from ..functions import timecode as tc
from ..operators import asof, catalog, edits, graph, intervals, mix, packets, ranges, resample
from ..operators import sequences as seqs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: 2024-01-01 in microseconds
T0 = 1_704_067_200_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """events with whole minutes and hours since the start of 2024."""
    e = t(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - T0
    return e.select("event_id", "user_id", "event_type", "value", tc._div(us, 60_000_000).alias("minute"), tc._div(us, 3_600_000_000).alias("hour"))


EV = f"ev as (select event_id, user_id, event_type, value, cast((epoch_us(ts) - {T0}) // 60000000 as bigint) as minute, cast((epoch_us(ts) - {T0}) // 3600000000 as bigint) as hour from events)"


def lines(spark: SparkSession, d: str, spread: bool = False) -> DataFrame:
    """lineitem as sequences by order: idx, length (quantity), transition and offset. With spread, tasks are as many as shuffle
    partitions, whatever the few bytes they read, for what makes more and wider rows of these."""
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").cast("long").alias("ln"), F.col("l_quantity").cast("long").alias("length"), F.col("l_partkey").cast("long").alias("part"), "l_suppkey")
    li = li.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq") if spread else li
    # by the columns' new names, so that what follows within a sequence needs no shuffle
    w = Window.partitionBy("seq").orderBy("ln", "part", "l_suppkey")
    li = li.select("seq", (F.row_number().over(w) - 1).cast("long").alias("idx"), "ln", "length", "part")
    return li.withColumn("transition_length", (F.col("ln") % 5 - 2)).withColumn("offset", F.col("part") % 100)


LI = "li as (select l_orderkey as seq, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as bigint) as idx, cast(l_linenumber as bigint) as ln, cast(l_quantity as bigint) as length, cast(l_partkey as bigint) as part, cast(l_linenumber as bigint) % 5 - 2 as transition_length, cast(l_partkey as bigint) % 100 as \"offset\" from lineitem)"


def items(spark: SparkSession, d: str) -> DataFrame:
    """events as timeline items, in minutes."""
    e = events(spark, d)
    return e.select(F.col("event_id").alias("item_id"), "user_id", F.col("minute").alias("x"), (1 + F.col("event_id") % 90).cast("long").alias("length"), (F.col("event_id") % 7).cast("long").alias("offset"), F.col("value").alias("v"))


IT = "it as (select event_id as item_id, user_id, minute as x, cast(1 + event_id % 90 as bigint) as length, cast(event_id % 7 as bigint) as \"offset\", value as v from ev)"


@query("select o_orderkey, cast(cast(o_orderkey as bigint) * 1001000000000 // 30000 + 1 as bigint) as ns, cast((cast(o_orderkey as bigint) * 1001000000000 // 30000 + 1) * 30000 // 1001000000000 as bigint) as frame from orders")
def frame_time_roundtrip(spark, d):
    o = t(spark, d, "orders").select("o_orderkey")
    ns = tc.frame_time(F.col("o_orderkey"), 30_000, 1_001)
    return o.select("o_orderkey", ns.alias("ns"), tc.time_frame(ns, 30_000, 1_001).alias("frame"))


_TC = "lpad(cast({s} // 3600 as varchar), cast(greatest(2, length(cast({s} // 3600 as varchar))) as integer), '0') || ':' || lpad(cast({s} // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast({s} % 60 as varchar), 2, '0') || '{p}' || lpad(cast(abs({f}) % {r} as varchar), 2, '0')"


@query(f"select o_orderkey, case when f < 0 then '-' else '' end || {_TC.format(s='(abs(f) // 25)', f='f', r=25, p=':')} as text from (select o_orderkey, o_orderkey - 5000 as f from orders)")
def timecode_format(spark, d):
    return t(spark, d, "orders").select("o_orderkey", tc.timecode_text(F.col("o_orderkey") - 5000, 25).alias("text"))


@query("select o_orderkey, cast(o_orderkey - 5000 as bigint) as frame, cast(o_orderkey % 60 + 25 * 7 as bigint) as partial from orders")
def timecode_parse(spark, d):
    """Formatting and parsing give the frame again; a text of two fields counts seconds and frames."""
    o = t(spark, d, "orders").select("o_orderkey")
    part = F.concat(F.lit("07:"), (F.col("o_orderkey") % 60).cast("string"))
    return o.select("o_orderkey", tc.timecode_frames(tc.timecode_text(F.col("o_orderkey") - 5000, 25), 25).alias("frame"), tc.timecode_frames(part, 25).alias("partial"))


@query(f"with a as (select o_orderkey, o_orderkey * 37 as f from orders), b as (select *, f + 18 * (f // 17982) + case when f % 17982 >= 1800 then 2 * ((f % 17982 - 1800) // 1798 + 1) else 0 end as n from a) select o_orderkey, {_TC.format(s='(n // 30)', f='n', r=30, p=';')} as text, cast(f as bigint) as frame from b")
def dropframe_format(spark, d):
    f = F.col("o_orderkey") * 37
    text = tc.drop_frame_text(f)
    return t(spark, d, "orders").select("o_orderkey", text.alias("text"), tc.drop_frame_frames(text).alias("frame"))


@query("select o_orderkey, cast((o_orderkey * 1001 + 15000) // 30000 as bigint) as half_up, cast(1000 + (o_orderkey * 3) // 2 as bigint) as clock, cast((o_orderkey * 5) // 3 as bigint) as varispeed from orders")
def rescale_and_clock(spark, d):
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", tc.rescale_half_up(k, 30_000, 1_001).alias("half_up"), tc.clock_time(k, F.lit(0), F.lit(1000), F.lit(3), F.lit(2)).alias("clock"), tc.varispeed_index(k, F.lit(5), F.lit(3)).alias("varispeed"))


@query(f"with {EV} select event_id, round(minute * 0.25 + 3.0, 6) as lin, round(minute / 1440.0 * -2.0 + 1.0, 6) as l0, round(least(1, greatest(0, minute / 1440.0)) * -2.0 + 1.0, 6) as held from ev")
def lerp_values(spark, d):
    e, m = events(spark, d), F.col("minute")
    return e.select("event_id", F.round(ff.linear(m, 0.25, 3.0), 6).alias("lin"), F.round(ff.lerp(m, [1.0], [-1.0], 1440)[0], 6).alias("l0"), F.round(ff.lerp(m, [1.0], [-1.0], 1440, clamp=True)[0], 6).alias("held"))


@query(f"""with {EV}, k as (select user_id, minute as frame, max(value) as v, cast(max(event_id) % 2 as int) as kind from ev where event_type = 'signup' group by user_id, minute),
n as (select *, lead(frame) over (partition by user_id order by frame) as nf, lead(v) over (partition by user_id order by frame) as nv, first_value(v) over (partition by user_id order by frame) as fv from k),
j as (select e.event_id, e.user_id, e.minute, n.frame, n.v, n.kind, n.nf, n.nv from ev e asof left join n on e.user_id = n.user_id and e.minute >= n.frame)
select event_id, round(case when j.frame is null then coalesce((select min_by(k.v, k.frame) from k where k.user_id = j.user_id), 0) when nf is null or kind = 0 then v else v + (nv - v) * ((minute - j.frame) / (nf - j.frame)) end, 6) as v from j""")
def keyframe_interp_hold_linear(spark, d):
    e = events(spark, d)
    k = e.where("event_type = 'signup'").groupBy("user_id", F.col("minute").alias("frame")).agg(F.max("value").alias("value"), (F.max("event_id") % 2).cast("int").alias("kind"))
    out = asof.interpolate(e.select("event_id", "user_id", "minute"), k, "minute", keys=["user_id"])
    return out.select("event_id", F.round("interpolated", 6).alias("v"))


@query(f"with {EV} select event_id, hour - 10 as hour from ev where hour - 10 >= 5 and hour - 10 < 200")
def shift_window(spark, d):
    return ranges.shift_window(events(spark, d).select("event_id", "hour"), "hour", 10, 5, 200)


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 0.5, 4) as q, round(l_discount * 2.0 + 0.1, 6) as g, round(l_tax * least(1.0, greatest(0.0, l_discount * 12)), 6) as a from lineitem")
def attenuate_gain_alpha(spark, d):
    li = ranges.attenuate(t(spark, d, "lineitem"), "l_linenumber", "l_quantity", 0.5)
    li = ranges.copy_alpha(li, F.col("l_discount") * 12, "l_tax")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_quantity", 4).alias("q"), F.round(ranges.gain_offset(F.col("l_discount"), 2.0, 0.1), 6).alias("g"), F.round("l_tax", 6).alias("a"))


@query(f"with {EV}, h as (select event_type, hour, sum(value) as v from ev group by all), s as (select event_type, unnest(generate_series(min(hour), max(hour))) as hour from h group by event_type) select event_type, hour, round(coalesce(v, 0), 2) as v from s left join h using (event_type, hour)")
def gap_fill_silence(spark, d):
    h = events(spark, d).groupBy("event_type", "hour").agg(F.sum("value").alias("v"))
    return ranges.fill(h, "hour", "v", ["event_type"]).select("event_type", "hour", F.round("v", 2).alias("v"))


@query(f"with {EV}, {IT} select p.event_id, count(*) as n_active, sum(p.minute - it.x + it.\"offset\") as source_index, max(it.item_id) as top_item from ev p join it on it.user_id = p.user_id and it.x <= p.minute and p.minute < it.x + it.length group by p.event_id")
def stab_join_active_items(spark, d):
    p = events(spark, d).select("event_id", "user_id", "minute")
    j = intervals.stab_join(p, items(spark, d), "minute", keys=["user_id"])
    return j.groupBy("event_id").agg(F.count("*").alias("n_active"), F.sum(F.col("minute") - F.col("x") + F.col("offset")).alias("source_index"), F.max("item_id").alias("top_item"))


@query("with o as (select o_orderkey, o_custkey, cast(date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as bigint) as x, cast(1 + o_orderkey % 120 as bigint) as l from orders) select a.o_orderkey as a, b.o_orderkey as b, least(a.x + a.l, b.x + b.l) - greatest(a.x, b.x) as shared from o a join o b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.x < b.x + b.l and b.x < a.x + a.l")
def overlap_join_pairs(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("x"), (1 + F.col("o_orderkey") % 120).cast("long").alias("l"))
    a, b = (o.select("o_custkey", *[F.col(c).alias(f"{p}{c}") for c in ("o_orderkey", "x", "l")]) for p in "ab")
    j = intervals.overlap_join(a, b, "ax", "al", "bx", "bl", ["o_custkey"]).where("ao_orderkey < bo_orderkey")
    return j.select(F.col("ao_orderkey").alias("a"), F.col("bo_orderkey").alias("b"), (F.least(F.col("ax") + F.col("al"), F.col("bx") + F.col("bl")) - F.greatest("ax", "bx")).alias("shared"))


@query(f"with {EV}, {IT}, f as (select user_id, min(x) as lo, max(x + length) as hi from it group by user_id), s as (select user_id, unnest(range(lo // 30 * 30, hi, 30)) as m from f) select s.user_id, m, round(sum(v), 2) as v from s join it on it.user_id = s.user_id and x <= m and m < x + length group by s.user_id, m")
def audio_mix_sum(spark, d):
    return mix.additive(intervals.grid_stab(items(spark, d), 30, "m"), ["user_id", "m"], "v").select("user_id", "m", F.round("v", 2).alias("v"))


@query(f"""with {EV}, l as (select hour, event_id, value as c, (1 + event_id % 8) / 11.0 as a from ev where event_type = 'click'),
x as (select *, coalesce(exp(sum(ln(1 - a)) over (partition by hour order by event_id desc rows between unbounded preceding and 1 preceding)), 1) as through from l)
select hour, round(sum(c * a * through) / sum(a * through), 3) as c, round(sum(a * through), 4) as a from x group by hour""")
def over_composite(spark, d):
    e = events(spark, d).where("event_type = 'click'").select("hour", "event_id", F.col("value").alias("c"), ((1 + F.col("event_id") % 8) / F.lit(11.0)).alias("a"))
    return mix.over(e, ["hour"], ["event_id"], ["c"], "a").select("hour", F.round("c", 3).alias("c"), F.round("a", 4).alias("a"))


@query(f"with {EV}, a as (select hour, sum(value) as v from ev where event_type = 'click' group by hour), b as (select hour, sum(value) as v from ev where event_type = 'view' group by hour) select hour, round(coalesce(a.v, 0) * (1 - least(1, hour / 240.0)) + coalesce(b.v, 0) * least(1, hour / 240.0), 7) as v from a full join b using (hour)")
def crossfade_outer(spark, d):
    e = events(spark, d)
    one = lambda k: e.where(F.col("event_type") == k).groupBy("hour").agg(F.sum("value").alias("v"))
    return mix.crossfade(one("click"), one("view"), ["hour"], "v", ff.crossfade_weight(F.col("hour"), 240)).select("hour", F.round("v", 7).alias("v"))


@query(f"with {EV} select user_id, hour, arg_max(value, event_id) as value from ev group by user_id, hour")
def overwrite_last_wins(spark, d):
    return mix.overwrite(events(spark, d), ["user_id", "hour"], "value", F.col("event_id"))


@query(f"with {LI} select seq, idx, cast(coalesce(sum(length) over (partition by seq order by idx rows between unbounded preceding and 1 preceding), 0) as bigint) as start from li")
def sequence_starts(spark, d):
    return seqs.starts(lines(spark, d), ["seq"], "idx", "length").select("seq", "idx", "start")


@query(f"with {LI}, s as (select *, coalesce(sum(length) over (partition by seq order by idx rows between unbounded preceding and 1 preceding), 0) as start from li), f as (select seq, unnest([10, 40, 90]) as frame from (select distinct seq from li)) select f.seq, frame, idx, cast(frame - start + \"offset\" as bigint) as source_frame from f join s on s.seq = f.seq and start <= frame and frame < start + length")
def sequence_lookup(spark, d):
    s = seqs.starts(lines(spark, d), ["seq"], "idx", "length")
    f = s.select("seq").distinct().withColumn("frame", F.explode(F.array(F.lit(10), F.lit(40), F.lit(90))))
    j = intervals.stab_join(f, s, "frame", x="start", keys=["seq"])
    return j.select("seq", "frame", "idx", (F.col("frame") - F.col("start") + F.col("offset")).alias("source_frame"))


_OV = f"{LI}, u as (select *, case when idx = 0 then 0 else transition_length end as tt from li), s as (select *, cast(coalesce(sum(length) over (partition by seq order by idx rows between unbounded preceding and 1 preceding), 0) - sum(tt) over (partition by seq order by idx) as bigint) as start, coalesce(lead(transition_length) over (partition by seq order by idx), 0) as nt, lead(\"offset\") over (partition by seq order by idx) as no from u)"


@query(f"with {_OV} select seq, idx, start, start + tt as region_start, length - tt as region_length, length - tt - greatest(0, nt) as mid, \"offset\" + tt as a_offset, case when nt > 0 then no - (length - tt - greatest(0, nt)) end as b_offset from s")
def sequence_overlap_starts(spark, d):
    p = seqs.render_plan(lines(spark, d), ["seq"], "idx", "length", "transition_length", "offset")
    return p.select("seq", "idx", "start", "region_start", "region_length", "mid", "a_offset", "b_offset")


@query(f"with {LI} select seq, cast(sum(length - transition_length) + min_by(transition_length, idx) as bigint) as length from li group by seq")
def sequence_length(spark, d):
    return seqs.total_length(lines(spark, d), ["seq"], "idx", "length", "transition_length")


@query(f"with {LI}, n as (select *, case when part % 3 <> 0 then part end as p from li) select seq, idx, last_value(p ignore nulls) over (partition by seq order by idx rows between unbounded preceding and 1 preceding) as previous, first_value(p ignore nulls) over (partition by seq order by idx rows between 1 following and unbounded following) as next from n")
def prev_next_skip(spark, d):
    return seqs.neighbours(lines(spark, d), ["seq"], "idx", "part", F.col("part") % 3 == 0).select("seq", "idx", "previous", "next")


@query(f"with {LI}, k as (select distinct seq, ln from li), g as (select seq, ln, ln - row_number() over (partition by seq order by ln) as island from k) select seq, island, min(ln) as first, max(ln) as last, count(*) as n from g group by seq, island")
def islands_adjacent(spark, d):
    i = seqs.islands(lines(spark, d).select("seq", "ln").distinct(), ["seq"], "ln")
    return i.groupBy("seq", "island").agg(F.min("ln").alias("first"), F.max("ln").alias("last"), F.count("*").alias("n"))


@query(f"with {LI} select seq, idx, cast(sum(case when idx = 0 or transition_length <= 0 then 1 else 0 end) over (partition by seq order by idx) as bigint) as group_no from li")
def overlap_movers(spark, d):
    return seqs.overlap_groups(lines(spark, d), ["seq"], "idx", "transition_length").select("seq", "idx", "group_no")


@query(f"with {EV}, o as (select o_orderkey, o_custkey, cast(o_orderkey % 43200 as bigint) as minute from orders), u as (select user_id as k, 0 as stream, event_id as id, minute from ev union all select o_custkey, 1, o_orderkey, minute from o) select k, stream, id, minute, row_number() over (partition by k order by minute, stream, id) as pos from u")
def mux_merge_order(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), "minute")
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 43_200).cast("long").alias("minute"))
    return seqs.merge([e, o], "minute", ["id"], ["k"]).select("k", "stream", "id", "minute", "pos")


@query(f"with {EV}, r as (select user_id, min(minute) as lo, max(minute) as hi from ev group by user_id), b as (select *, unnest(range(0, (hi - lo) // 1024 + 1)) as block from r), g as (select user_id, (minute - lo) // 1024 as block, sum(value) as v from ev join r using (user_id) group by all) select user_id, block, lo + block * 1024 as first, least(1024, hi - lo - block * 1024 + 1) as n, round(coalesce(v, 0), 2) as v from b left join g using (user_id, block)")
def cluster_blocks_1024(spark, d):
    e = events(spark, d)
    r = e.groupBy("user_id").agg(F.min("minute").alias("lo"), F.max("minute").alias("hi"))
    b = packets.blocks(e.join(r, "user_id"), ["user_id"], "minute", "value", F.col("lo"), F.col("hi"))
    return b.select("user_id", "block", "first", F.size("samples").cast("long").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 2).alias("v"))


@query(f"""with recursive {EV}, n as (select event_id, user_id, minute, row_number() over (partition by user_id order by minute, event_id) as r from ev),
f as (select event_id, user_id, minute, r, minute as start, cast(0 as bigint) as cluster from n where r = 1 union all
select n.event_id, n.user_id, n.minute, n.r, case when abs(n.minute - f.start) > 2000 then n.minute else f.start end, f.cluster + case when abs(n.minute - f.start) > 2000 then 1 else 0 end from f join n on n.user_id = f.user_id and n.r = f.r + 1)
select event_id, cluster from f""")
def cluster_anchor_start(spark, d):
    e = events(spark, d).select("event_id", "user_id", "minute").withColumn("bytes", F.lit(1))
    return packets.clusters(e, "user_id", ["minute", "event_id"], "minute", "bytes", ticks=2000).select("event_id", "cluster")


@query(f"with {EV}, a as (select event_id, hour - 24 as hour from ev where event_type = 'click' and hour >= 24 and hour < 124), b as (select event_id, hour - 0 + 100 as hour from ev where event_type = 'view' and hour >= 0 and hour < 50) select * from a union all select * from b")
def concat_union_shift(spark, d):
    e = events(spark, d)
    part = lambda k: e.where(F.col("event_type") == k).select("event_id", "hour")
    return seqs.concat([(part("click"), 24, 100), (part("view"), 0, 50)], "hour")


_PD = " union all ".join(f"select {c} as cadence, o_orderkey, (o_orderkey + {min(c, 3)}) // 4 * 5 + case when (o_orderkey + {min(c, 3)}) % 4 < 2 then (o_orderkey + {min(c, 3)}) % 4 else (o_orderkey + {min(c, 3)}) % 4 + 1 end - {c} as even, (o_orderkey + {min(c, 3)}) // 4 * 5 + case when (o_orderkey + {min(c, 3)}) % 4 < 3 then (o_orderkey + {min(c, 3)}) % 4 else 4 end - {c} as odd, o_orderkey // 5 * 4 + o_orderkey % 5 - case when o_orderkey % 5 > {(2 - c) % 5} then 1 else 0 end as new_length from orders" for c in range(5))


@query(_PD)
def pulldown_map(spark, d):
    o, out = t(spark, d, "orders").select("o_orderkey"), None
    for c in range(5):
        even, odd = resample.pulldown(F.col("o_orderkey"), c)
        one = o.select(F.lit(c).alias("cadence"), "o_orderkey", even.alias("even"), odd.alias("odd"), resample.pulled_length(F.col("o_orderkey"), c).alias("new_length"))
        out = one if out is None else out.unionByName(one)
    return out


_TAPS = sig.triangle_taps(0.5)


@query(f"with {EV}, h as (select event_type, hour, sum(value) as v from ev group by all), t(k, w) as (values {', '.join(f'({k}, {w!r})' for k, w in _TAPS)}) select event_type, (hour - k) // 2 as hour, round(sum(v * w), 4) as v from h, t where (hour - k) % 2 = 0 and hour - k >= 0 group by event_type, (hour - k) // 2")
def resample_triangle(spark, d):
    h = events(spark, d).groupBy("event_type", "hour").agg(F.sum("value").alias("v"))
    return resample.subsample(h, ["event_type"], "hour", "v", _TAPS, 2).where("hour >= 0").select("event_type", "hour", F.round("v", 4).alias("v"))


@query("select p_partkey, round(p_size / 32767.0, 9) as s16, round(p_size / 127.0 - 1, 9) as u8, round((p_size - 16) / 219.0, 9) as luma, round((p_size - 128) / 224.0, 9) as chroma from part")
def pcm_scale(spark, d):
    s = F.col("p_size")
    return t(spark, d, "part").select("p_partkey", F.round(sig.pcm(s, "s16"), 9).alias("s16"), F.round(sig.pcm(s, "u8"), 9).alias("u8"), F.round(sig.luma_float(s), 9).alias("luma"), F.round(sig.chroma_float(s), 9).alias("chroma"))


@query("with p as (select p_partkey, p_size / 50.0 as r, p_partkey % 100 / 100.0 as g, p_partkey % 7 / 7.0 as b from part), y as (select *, 0.2126 * r + 0.7152 * g + 0.0722 * b as y from p) select p_partkey, round(y, 7) as y, round((b - y) / 1.8556, 7) as cb, round((r - y) / 1.5748, 7) as cr, round(r, 7) as r, round(case when r < 0.081 then r / 4.5 else pow((r + 0.099) / 1.099, 1 / 0.45) end, 7) as linear, round(case when g <= 0.0031308 then g * 12.92 else 1.055 * pow(g, 1 / 2.4) - 0.055 end, 7) as srgb from y")
def studio_ycbcr(spark, d):
    """To Y, Cb, Cr and back, and transfer curves."""
    p = t(spark, d, "part").select("p_partkey", (F.col("p_size") / F.lit(50.0)).alias("r"), (F.col("p_partkey") % 100 / F.lit(100.0)).alias("g"), (F.col("p_partkey") % 7 / F.lit(7.0)).alias("b"))
    y, cb, cr = sig.ycbcr(F.col("r"), F.col("g"), F.col("b"))
    back = sig.rgb(y, cb, cr)[0]
    return p.select("p_partkey", F.round(y, 7).alias("y"), F.round(cb, 7).alias("cb"), F.round(cr, 7).alias("cr"), F.round(back, 7).alias("r"), F.round(sig.rec709_to_linear(F.col("r")), 7).alias("linear"), F.round(sig.linear_to_srgb(F.col("g")), 7).alias("srgb"))


@query("select p_partkey, p_brand, row_number() over (partition by p_brand order by p_size, p_partkey) - 1 as z from part")
def zorder_rerank(spark, d):
    return seqs.rerank(t(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], ["p_size", "p_partkey"]).select("p_partkey", "p_brand", "z")


_BOX = "b as (select o_custkey, o_orderkey as id, cast(date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as bigint) as x, cast(30 + o_orderkey % 200 as bigint) as l, o_orderkey % 10 as y, 3 as h, o_orderkey % 17 as z from orders)"
_PAIR = f"{_BOX}, p as (select a.o_custkey, a.id as a, b.id as b, a.z as za, b.z as zb from b a join b on a.o_custkey = b.o_custkey and a.id <> b.id and a.x < b.x + b.l and b.x < a.x + a.l and a.y < b.y + b.h and b.y < a.y + a.h)"


def _boxes(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_custkey", F.col("o_orderkey").alias("id"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("x"), (30 + F.col("o_orderkey") % 200).cast("long").alias("l"), (F.col("o_orderkey") % 10).alias("y"), F.lit(3).alias("h"), (F.col("o_orderkey") % 17).alias("z"))


@query(f"with {_PAIR} select a, b from p")
def box_overlap_pairs(spark, d):
    return intervals.box_overlaps(_boxes(spark, d), "id", "x", "l", "y", "h", ["o_custkey"]).select("a", "b")


@query(f"with recursive {_PAIR}, up as (select a as origin, b as node, zb as z from p where zb > za union select up.origin, p.b, p.zb from up join p on p.a = up.node and p.zb > p.za), down as (select a as origin, b as node, zb as z from p where zb < za union select down.origin, p.b, p.zb from down join p on p.a = down.node and p.zb < p.za) select origin, node from up union select origin, node from down")
def overlap_stack_closure(spark, d):
    b = _boxes(spark, d)
    o = intervals.box_overlaps(b, "id", "x", "l", "y", "h", ["o_custkey"]).select("a", "b")
    return graph.overlap_stack(b.select(F.col("id").alias("origin")), o, b.select("id", "z"))


@query("with recursive e as (select c_custkey as source, c_custkey // 3 as target from customer union select c_custkey // 3, c_custkey from customer where c_acctbal < 0), r as (select s_suppkey as origin, s_suppkey as node from supplier union select r.origin, e.target from r join e on e.source = r.node) select origin, node from r")
def anchor_reach(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("source"), tc._div(F.col("c_custkey"), 3).alias("target"), (F.col("c_acctbal") < 0).alias("two_way"))
    start = t(spark, d, "supplier").select(F.col("s_suppkey").alias("origin"))
    return graph.closure(start, graph.both_ways(c, "source", "target", "two_way"))


@query("select n_nationkey as origin, k as node from nation, (select c_custkey as k from customer union select c_custkey - 1 from customer) where k >= n_nationkey")
def chain_reach(spark, d):
    """A chain of all customers, far deeper than it is broad."""
    k = F.col("c_custkey")
    return graph.closure(t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("origin")), t(spark, d, "customer").select((k - 1).cast("long").alias("source"), k.cast("long").alias("target")))


@query("with c as (select c_custkey as id, c_nationkey as g, c_custkey % 7 as rate, row_number() over (partition by c_nationkey order by c_custkey) as r, count(*) over (partition by c_nationkey) as n from customer), f as (select g, arg_min(r, rate * 1000000000 + id) as f from c group by g) select id, cast((f - r + n) % n as int) as depth from c join f using (g)")
def anchor_circles(spark, d):
    """Each nation's customers as a circle, broken at the lowest rate."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    nxt = F.coalesce(F.lead("c_custkey").over(w), F.min("c_custkey").over(Window.partitionBy("c_nationkey")))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7).alias("rate"), nxt.alias("to"))
    return graph.anchor_order(c.select("id", "rate"), c.select(F.col("id").alias("source"), F.col("to").alias("target"))).select("id", "depth")


@query("select o_orderkey, cast((cast(o_orderkey as hugeint) * 1001 * 1000000000 // 30000 + 1 + o_custkey * 1000 + 1000000000 // 96000 + 1) * 48000 // 1000000000 as bigint) as x, o_totalprice + 2.5 as y from orders")
def anchor_solve(spark, d):
    x = graph.anchored_x(F.col("o_orderkey"), F.col("o_custkey") * 1000, 30_000, 1_001, 48_000, 1)
    return t(spark, d, "orders").select("o_orderkey", x.alias("x"), graph.anchored_y(F.col("o_totalprice"), F.lit(2.5)).alias("y"))


@query("select s_nationkey, s_suppkey, s_acctbal from (select *, row_number() over (partition by s_nationkey order by floor(s_acctbal / 1000) desc, s_name desc) as r from supplier) where r = 1")
def priority_codec_choice(spark, d):
    s = t(spark, d, "supplier").withColumn("priority", F.floor(F.col("s_acctbal") / 1000))
    return catalog.choose(s, ["s_nationkey"], "priority", "s_name").select("s_nationkey", "s_suppkey", "s_acctbal")


@query("select o_orderkey, case when c.c_custkey is null then 'missing' when c.c_acctbal < 0 then 'offline' end as alert from orders left join (select * from customer where c_mktsegment <> 'BUILDING') c on c.c_custkey = o_custkey")
def asset_resolution_alerts(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("path"))
    c = t(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("path"), "c_acctbal")
    return catalog.resolve(o, c, "path", F.col("c_acctbal") < 0).select("o_orderkey", "alert")


@query("with b as (select p_partkey, p_partkey % 9 as ax, p_partkey % 9 + p_size % 6 as ay, p_partkey % 7 + 2 as bx, p_partkey % 7 + 5 as b_y from part), i as (select *, greatest(ax, bx) as lo, least(ay, b_y) as hi from b) select p_partkey, lo as min_x, hi as max_x, case when hi < lo then 0 else hi - lo + 1 end as width, greatest(ay, b_y) - least(ax, bx) as union_span from i")
def box_geometry(spark, d):
    k = F.col("p_partkey")
    a = geo.box(k % 9, F.lit(0), k % 9 + F.col("p_size") % 6, F.lit(9))
    b = geo.box(k % 7 + 2, F.lit(0), k % 7 + 5, F.lit(9))
    i, u = geo.intersect(a, b), geo.union(a, b)
    return t(spark, d, "part").select("p_partkey", i.min_x.alias("min_x"), i.max_x.alias("max_x"), geo.size_int(i).x.alias("width"), geo.size_float(u).x.alias("union_span"))


_EDIT = f"{_OV}, kept as (select *, lag(start + length) over (partition by seq order by idx) as e from s where part % 4 <> 0), removed as (select seq, row_number() over (partition by seq order by idx) - 1 as idx, length, coalesce(e - start, 0) as transition_length, part from kept), longer as (select *, case when part % 2 = 1 then greatest(5, 1 - length) else 0 end as by_ from removed)"


@query(f"with {_EDIT} select seq, idx, cast(length + by_ as bigint) as length, cast(transition_length + coalesce(lag(by_) over (partition by seq order by idx), 0) as bigint) as transition_length, part from longer")
def edit_log_replay(spark, d):
    """Remove items in place, then lengthen some; the neighbours keep their times."""
    gone = lambda x: edits.remove(x, F.col("part") % 4 == 0)
    longer = lambda x: edits.set_length(x, F.col("part") % 2 == 1, F.lit(5))
    return edits.compound(lines(spark, d), [gone, longer]).select("seq", "idx", "length", "transition_length", "part")


@query(f"with {LI} select seq, idx, length, \"offset\", transition_length, part, ln from li")
def edit_undo(spark, d):
    """An edit, its log, and the log taken back: the table as it was."""
    before = lines(spark, d)
    after = edits.remove(before, F.col("part") % 4 == 0).select(*before.columns)
    key = ["seq", "idx"]
    return edits.replay(after, edits.log(before, after, key, 1), key, undo=True).select("seq", "idx", "length", "offset", "transition_length", "part", "ln")


@query(f"with {EV}, {IT} select item_id, least(x, x + item_id % 5 - 2) as lo, greatest(x + length, x + item_id % 5 - 2 + length + item_id % 3) - 1 as hi from it where item_id % 5 <> 2 or item_id % 3 <> 0")
def dirty_ranges(spark, d):
    i = items(spark, d).select("item_id", "x", "length")
    new = i.select("item_id", (F.col("x") + F.col("item_id") % 5 - 2).alias("x"), (F.col("length") + F.col("item_id") % 3).alias("length"))
    return edits.dirty(i, new, ["item_id"])


@query(f"with {EV}, n as (select event_id, user_id, minute, row_number() over (partition by user_id order by minute, event_id) as r from ev) select event_id, cast(coalesce(sum(1024 + event_id % 7) over (partition by user_id order by r rows between unbounded preceding and 1 preceding), 0) as bigint) as sample from n")
def sample_positions(spark, d):
    w = Window.partitionBy("user_id").orderBy("minute", "event_id")
    e = events(spark, d).withColumns({"r": F.row_number().over(w), "n": (1024 + F.col("event_id") % 7).cast("long")})
    return packets.sample_positions(e, ["user_id"], "r", "n").select("event_id", "sample")


@query(f"with {EV}, e as (select user_id, minute from ev), near as (select user_id, min_by(minute, abs(minute - 20000) * 100000 + minute) as minute from e where abs(minute - 20000) < 3000 group by user_id) select * from near")
def nearest_edge(spark, d):
    return seqs.nearest(events(spark, d).select("user_id", "minute"), ["user_id"], "minute", F.lit(20_000), 3_000)


@query(f"with {EV} select event_type, min(minute) as lo, max(minute + 1 + event_id % 90) as hi from ev group by event_type")
def bounding_range(spark, d):
    e = events(spark, d).withColumn("hi", F.col("minute") + 1 + F.col("event_id") % 90).withColumnRenamed("minute", "lo")
    return mix.bounds(e, ["event_type"], "lo", "hi")


@query(f"with {LI}, w as (select *, cast(coalesce(sum(length) over (partition by seq order by idx rows between unbounded preceding and 1 preceding), 0) * 2 as bigint) as x from li), g as (select seq, idx, coalesce(lag(x + length) over (partition by seq order by idx), 0) as lo, x from w) select seq, idx, lo, x - 12 as hi from g where x - lo >= 12")
def free_slots(spark, d):
    s = seqs.starts(lines(spark, d), ["seq"], "idx", "length").withColumn("x", F.col("start") * 2)
    return edits.free_slots(s, "seq", "idx", "x", "length", 12)
