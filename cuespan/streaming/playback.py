"""Channels of packets and clock commands: sample positions, presentation times and late packets, in batch and on a stream.

Rows are (channel, at timestamp, seq bigint, command string, seek_ns, n, d, time_ns, duration_ns, samples). A row with a command (play at n / d,
stop, or seek to seek_ns) moves its channel's clock; one without is a packet. Of each packet come out the sample where
it begins (the sum of the packets before it), the clock's time when it arrives, and whether it is late: a clock that plays
forward shows packets from its time and the last packet's duration on, backward those up to it; one that stands shows all.
Times are whole numbers, cut off towards zero where the speed divides them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROWS = "channel bigint, at timestamp, seq bigint, command string, seek_ns bigint, n bigint, d bigint, time_ns bigint, duration_ns bigint, samples bigint"
SHOWN = "channel bigint, at timestamp, seq bigint, sample bigint, now_ns bigint, late boolean"
WAITING = "at_us bigint, seq bigint, command string, seek_ns bigint, n bigint, d bigint, time_ns bigint, duration_ns bigint, samples bigint"


def _passed(ns, n, d):
    """ns * n / d, cut off towards zero."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.coalesce(F.call_function("div", wide(ns) * wide(n), wide(d)), F.lit(0))


def played(rows: DataFrame) -> DataFrame:
    """SHOWN of every packet of a table of ROWS; all steps are windows along a channel."""
    w = Window.partitionBy("channel").orderBy("at", "seq")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    at = F.unix_micros("at") * 1000
    turns = F.col("command").isin("play", "stop")
    speed = F.when(F.col("command") == "play", F.struct("n", "d")).when(F.col("command") == "stop", F.struct(F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("d")))
    d = rows.withColumns({"_at": at, "_speed": F.last(F.when(turns, speed), True).over(past), "_since": F.last(F.when(F.col("command").isNotNull(), at), True).over(past)})
    # from the command before, a clock has run on by this much; it is counted from command to command
    d = d.withColumn("_ran", _passed(F.col("_at") - F.col("_since"), F.col("_speed.n"), F.col("_speed.d")))
    sought = F.col("command") == "seek"
    d = d.withColumn("_seeks", F.sum(F.when(sought, 1).otherwise(0)).over(upto))
    inside = Window.partitionBy("channel", "_seeks").orderBy("at", "seq")
    gone = F.sum(F.when(F.col("command").isNotNull() & ~F.coalesce(sought, F.lit(False)), F.col("_ran")).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    base = F.first(F.when(sought, F.col("seek_ns")), True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_now", (F.coalesce(base, F.lit(0)) + F.coalesce(gone, F.lit(0)) + F.when(sought, 0).otherwise(F.col("_ran"))).cast("long"))
    packet = F.col("command").isNull()
    d = d.withColumns({"sample": F.coalesce(F.sum(F.when(packet, F.col("samples"))).over(past), F.lit(0)), "_last": F.coalesce(F.abs(F.last(F.when(packet, F.col("duration_ns")), True).over(past)), F.lit(0))})
    v, now = F.coalesce("_speed.n", F.lit(0)), F.col("_now")
    late = F.when(v > 0, F.col("time_ns") < now + F.col("_last")).when(v < 0, F.col("time_ns") > now - F.col("_last")).otherwise(False)
    return d.where(packet).select("channel", "at", "seq", "sample", now.alias("now_ns"), late.alias("late"))


class _Channel(StatefulProcessor):
    """A channel's clock and position, and the rows that wait until none before them can come any more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "base_us bigint, seek_ns bigint, n bigint, d bigint, sample bigint, last_ns bigint")
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        first = None
        for p in rows:
            # microseconds since 1970; a missing value stays one
            us = p["at"].astype("datetime64[us]").astype("int64")
            cols = [p[c].astype(object).where(p[c].notna(), None) for c in ("seq", "command", "seek_ns", "n", "d", "time_ns", "duration_ns", "samples")]
            self.waiting.appendList([tuple(int(x) if isinstance(x, float) else x for x in r) for r in zip(us.tolist(), *cols, strict=True)])
            first = min(us.min(), first if first is not None else us.min())
        if first is not None:
            self.handle.registerTimer(-(-int(first) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        ready = [r for r in rows if r[0] <= mark]
        rest = rows[len(ready) :]
        self.waiting.clear()
        if rest:
            self.waiting.appendList(rest)
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        base, seek, n, d, sample, last = self.state.get() if self.state.exists() else (0, 0, 0, 1, 0, 0)
        out = []
        for at, seq, command, seek_ns, pn, pd_, time_ns, duration, samples in ready:
            run = (at - base) * 1000 * n
            now = seek + (run // d if (run < 0) == (d < 0) else -(-run // d))
            if command is None:
                late = time_ns < now + last if n > 0 else time_ns > now - last if n < 0 else False
                out.append((key[0], pd.Timestamp(at, unit="us"), seq, sample, now, late))
                sample, last = sample + samples, abs(duration)
                continue
            base, seek = at, seek_ns if command == "seek" else now
            n, d = (pn, pd_) if command == "play" else (0, 1) if command == "stop" else (n, d)
        if ready:
            self.state.update((base, seek, n, d, sample, last))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SHOWN.split(", ")])

    def close(self) -> None:
        pass


def play_stream(rows: DataFrame, late: str) -> DataFrame:
    """played() on a stream of ROWS: a row counts in its place in time as long as it comes no more than `late` behind the newest one.

    What comes out, comes when the watermark has passed it. State is kept by RocksDB, which the session must be set to."""
    marked = rows.withWatermark("at", late)
    return marked.groupBy("channel").transformWithStateInPandas(_Channel(), SHOWN, "Append", "EventTime")


#: The setting that play_stream() needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
