"""Streams: tumbling blocks, late rows, change ranges and clock state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Sums by block of time; rows later than `late` behind the newest are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.sum(value).alias(value), F.count("*").alias("n"))


def changes(stream: DataFrame, time: str, late: str) -> DataFrame:
    """The range (lo, hi) that changes (stream_id, lo, hi) touch in each second."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 second"), "stream_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def on_time(frames: DataFrame, now: Column, last: Column, speed: Column, time: str = "time_ns") -> DataFrame:
    """The frames that can still be shown: of a clock that plays forward those from now and the last frame's
    duration on, backward those up to it; a clock that stands shows all."""
    d = F.abs(last)
    return frames.where(F.when(speed > 0, F.col(time) >= now + d).when(speed < 0, F.col(time) <= now - d).otherwise(True))


CLOCK = "clock_id string, at_ns bigint, seek_ns bigint, n bigint, d bigint, time_ns bigint"


def clock(commands: DataFrame) -> DataFrame:
    """Clock commands (clock_id, at_ns, command, seek_ns, n, d) to the clock's state after each.

    Commands: play (n / d), stop, seek (seek_ns). The state of a clock is four numbers. Times are whole numbers
    throughout, cut off towards zero.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def passed(ns: int, n: int, d: int) -> int:
        return ns * n // d if (ns * n < 0) == (d < 0) else -(-ns * n // d)

    def step(key, parts, state: GroupState):
        base, seek, n, d = state.get if state.exists else (0, 0, 0, 1)
        rows = pd.concat(list(parts)).sort_values("at_ns")
        out = []
        for r in rows.itertuples(index=False):
            now = seek + (passed(int(r.at_ns) - base, n, d) if n else 0)
            base, seek = int(r.at_ns), int(r.seek_ns) if r.command == "seek" else now
            n, d = (int(r.n), int(r.d)) if r.command == "play" else (0, 1) if r.command == "stop" else (n, d)
            out.append((key[0], base, seek, n, d, seek))
        state.update((base, seek, n, d))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in CLOCK.split(", ")])

    return commands.groupBy("clock_id").applyInPandasWithState(step, CLOCK, "base bigint, seek bigint, n bigint, d bigint", "append", GroupStateTimeout.NoTimeout)
