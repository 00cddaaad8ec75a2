"""Variable-length integers of a binary container, as Column expressions that give binary values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bytes(v: Column, n: int) -> Column:
    """The low n bytes of v, the highest first."""
    return F.unhex(F.right(F.lpad(F.hex(v.cast("long")), 16, "0"), F.lit(2 * n)))


def encode_size(v: Column) -> Column:
    """A size in as few bytes as hold it: n bytes have 7 n bits, below a bit that tells n; all bits set is kept free."""
    out = F.when(v < 0, F.raise_error(F.lit("a size is not negative")))
    for n in range(1, 9):
        top = 1 << 7 * n
        out = out.when(v < top - 1, _bytes(v.cast("long").bitwiseOR(F.lit(top)), n))
    return out.otherwise(F.raise_error(F.lit("the size is too large")))


def encode_int(v: Column) -> Column:
    """A whole number in few bytes, without the leading zero byte that would mark it as positive."""
    v = v.cast("long")
    bits = F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v))))
    n = F.floor(bits / 8).cast("int") + 1
    out = F.when(v == 0, F.unhex(F.lit("00")))
    for k in range(1, 9):
        out = out.when(n == k, _bytes(v, k))
    held = F.hex(out)
    return F.when((v > 0) & held.startswith("00"), F.unhex(F.substring(held, 3, 16))).otherwise(out)


def make_void(size: int) -> bytes:
    """An element of that size that readers pass over: its mark, its size, and zeros."""
    if size == 0:
        return b""
    if not 2 <= size <= 128:
        raise ValueError("a void element has 2 to 128 bytes, or none")
    return b"\xec" + bytes([0x80 | (size - 2)]) + b"\0" * (size - 2)
