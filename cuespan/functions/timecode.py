"""Rational rates, nanosecond times and timecodes as Column expressions.

A rate is n / d frames a second. Integer division truncates toward zero unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000


def _div(a: Column, b) -> Column:
    """Whole quotient, truncated toward zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def floor_div(a: Column, b: int) -> Column:
    """Whole quotient, rounded down: a - pmod(a, b) is divisible, so the division is exact."""
    return _div(a - F.pmod(a, F.lit(b)), b)


def frame_time(frame: Column, n: int, d: int = 1) -> Column:
    """The first nanosecond after the start of a frame. Whole seconds and the rest are scaled apart, within 64 bits."""
    a = frame.cast("long") * d
    return _div(a, n) * NS + _div(a % n * NS, n) + 1


def time_frame(ns: Column, n: int, d: int = 1) -> Column:
    """The frame on screen at a nanosecond."""
    ns, unit = ns.cast("long"), NS * d
    return _div(ns, unit) * n + _div(ns % unit * n, unit)


def rescale_half_up(ts: Column, n: int, d: int) -> Column:
    """Time stamps from units of n / d to frames, halves up."""
    return _div(ts * d + n // 2, n)


def container_tick(sample: Column, rate: int, scale: int) -> Column:
    """Nanoseconds of a sample in units of scale; both roundings are half to even."""
    return F.bround(F.bround(sample * F.lit(float(NS)) / rate) / scale).cast("long")


def clock_time(now: Column, base: Column, seek: Column, n: Column, d: Column) -> Column:
    """Presentation time of a clock that plays at n / d; it stands still where n is 0.

    Whole parts of d and the rest are scaled apart, so that the product doesn't leave 64 bits."""
    ran = now - base
    return seek + _div(ran, d) * n + _div((ran - _div(ran, d) * d) * n, d)


def varispeed_index(i: Column, n: Column, d: Column) -> Column:
    """The source index of output i at speed n / d, counted from where reading begins; backward as forward."""
    return _div(i * F.abs(n), d)


def frames_text(frame: Column) -> Column:
    return frame.cast("long").cast("string")


def frames_parse(text: Column) -> Column:
    """The frame of a plain number's text."""
    return F.trim(text).cast("long")


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's rule; 64-bit numbers need 92 steps at most."""
    step = lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), (s.a % F.when(s.b == 0, 1).otherwise(s.b)).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(F.abs(a).alias("a"), F.abs(b).alias("b")), step).a


def rational(n: Column, d: Column) -> Column:
    """n / d in lowest terms as a struct (n, d) with d > 0; null where d is 0."""
    n, d = n.cast("long"), d.cast("long")
    g = _gcd(n, d) * F.signum(d).cast("long")
    return F.when(d != 0, F.struct(_div(n, g).alias("n"), _div(d, g).alias("d")))


def rational_parse(text: Column) -> Column:
    """A whole number's text or one of n/d as a rational in lowest terms."""
    part = F.split(text, "/")
    return rational(F.get(part, 0).cast("long"), F.coalesce(F.get(part, 1).cast("long"), F.lit(1).cast("long")))


def timecode_text(frame: Column, fps: int, sep: str = ":") -> Column:
    """[-]hh:mm:ss:ff"""
    a = F.abs(frame)
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    s = _div(a, fps)
    return F.concat(F.when(frame < 0, "-").otherwise(""), two(_div(s, 3600)), F.lit(":"), two(_div(s, 60) % 60), F.lit(":"), two(s % 60), F.lit(sep), two(a % fps))


def timecode_frames(text: Column, fps: int) -> Column:
    """Frames of a timecode; fields missing on the left are 0."""
    body = F.regexp_replace(text, "^-", "")
    part = F.reverse(F.split(body, "[:;]"))
    v = lambda i: F.coalesce(F.get(part, i).cast("long"), F.lit(0))
    return F.when(text.startswith("-"), -1).otherwise(1) * (v(0) + fps * (v(1) + 60 * (v(2) + 60 * v(3))))


def drop_frame_number(frame: Column) -> Column:
    """Frames at 30 / 1.001 to nominal 30 fps numbers: two are skipped each minute but each tenth."""
    tens, rest = floor_div(frame, 17_982), F.pmod(frame, F.lit(17_982))
    return frame + 18 * tens + F.when(rest >= 1_800, 2 * (_div(rest - 1_800, 1_798) + 1)).otherwise(0)


def drop_frame_text(frame: Column) -> Column:
    return timecode_text(drop_frame_number(frame), 30, ";")


def drop_frame_frames(text: Column) -> Column:
    """Frames of a drop-frame timecode."""
    n = timecode_frames(text, 30)
    minutes = floor_div(n, 1_800)
    return n - 2 * (minutes - floor_div(minutes, 10))


def major_ticks(fps: int) -> list[int]:
    """Frame counts at which a ruler has its larger marks."""
    return [1, fps, fps * 10, fps * 60, fps * 600, fps * 3600, fps * 36_000]


def space_rate(kind: Column, video: tuple[int, int], audio: tuple[int, int]) -> Column:
    """The rate of a stream kind; others are an error."""
    rate = lambda r: F.struct(F.lit(r[0]).alias("n"), F.lit(r[1]).alias("d"))
    return F.when(kind == "video", rate(video)).when(kind == "audio", rate(audio)).otherwise(F.raise_error(F.concat(F.lit("no rate for "), kind)))
