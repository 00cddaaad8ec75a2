"""Small helpers that the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters that part words in the whitespace word rule.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a local session has a folder of its own;
    a cluster's executors could not see that, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/cuespan-shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def asc_lower(c: Column) -> Column:
    """Lower-case A-Z alone. Where a text has no other cased letters this is lower()."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(c: Column) -> Column:
    """The words of a text, parted by ASCII white space; null text gives none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACES), lambda x: x != "")


def fenced(c: Column) -> Column:
    """c behind a test that always holds and that the optimizer must take for a row of its own kind.

    A filter over c then stays above its projection. Else the optimizer puts c's whole expression in
    the filter's place, and a list that a lambda reads is made anew for each element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


#: What a broadcast holds at most, by the bytes of its columns' values.
BROADCAST = 32 << 20


def _bytes(df: DataFrame):
    """The bytes of a row: fixed kinds count 8, strings and arrays what they hold."""
    kinds = dict(df.dtypes)
    size = lambda c, k: F.octet_length(c) if k in ("string", "binary") else F.size(c) * 8 if k in ("array<bigint>", "array<int>", "array<double>") else F.octet_length(F.to_json(F.struct(c))) if k.startswith(("array<", "map<", "struct<")) else F.lit(8)
    return sum((F.coalesce(size(F.col(f"`{c}`"), k), F.lit(0)) for c, k in kinds.items()), F.lit(16))


def bounded_broadcast(df: DataFrame, rows: int, size: int = BROADCAST) -> DataFrame:
    """Broadcast df if its counted rows and bytes stay within the bounds; else leave the join to a shuffle.

    df is read for it, so it is stored or cheap."""
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


#: What stands for a null id among whole numbers and among texts.
NO_ID, NO_NAME = -(1 << 63), "\0"


def id_key(df: DataFrame, name: str) -> Column:
    """The column as a key without nulls: whole numbers as bigint, others as text."""
    c = df[f"`{name}`"]
    whole = df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.coalesce(c.cast("bigint"), F.lit(NO_ID)) if whole else F.coalesce(c.cast("string"), F.lit(NO_NAME))


def key_id(key: Column) -> Column:
    """The id that a key of id_key() stands for."""
    return F.when(~key.cast("string").isin(str(NO_ID), NO_NAME), key)


def text_hash(c: Column) -> Column:
    return F.xxhash64(F.coalesce(c, F.lit("")))


def text_keys(d: DataFrame) -> DataFrame | None:
    """(id, th, key, c) of the different (id, text hash) of d (id, t), if some id has different texts; c: rows.

    Keys order as (id, th) do: they are numbered along a sort, partition by partition. Null ids have none."""
    d = d.where("id is not null").select("id", text_hash(F.col("t")).alias("th"))
    if d.groupBy("id").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo <> hi").isEmpty():
        return None
    pairs = d.groupBy("id", "th").agg(F.count("*").alias("c")).orderBy("id", "th")
    return stored(pairs.select("id", "th", F.monotonically_increasing_id().alias("key"), "c"), "keys")


def local_file(name: str) -> str:
    """Where a file of the public tokenizers is; the folder is a parameter of the environment."""
    base = os.environ.get("TOKENIZER_DIR")
    if base:
        return f"{base}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def freed(f):
    """f, a function of record batches, after which the Python worker gives memory back that it no longer uses:
    workers live on beside those of later stages."""

    def run(batches):
        import pyarrow as pa

        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def parts(batches, rows: int = 512, size: int = 4 << 20, text: str = "t"):
    """Slices of record batches with at most so many rows, and texts of so many bytes together or one text.

    Spark bounds the batches themselves by bytes; this bounds what a task turns into Python objects at once."""
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            most = (ends[at - 1] if at else 0) + size
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, most, side="right"))))
            yield b.slice(at, to - at)
            at = to


def lookup(left: DataFrame, right: DataFrame, keys: list[str], weight: str, rows: int = 100_000) -> DataFrame:
    """left joined (left outer) to right, which has one row for each key; weight: its number of left rows.

    right is stored and counted. Within the bound it is broadcast. Beyond it, the keys that hold a
    thousandth of all rows or more (a thousand keys at most) are broadcast, and their rows leave the
    shuffle join, each under a key of its own.
    """
    right = stored(right, "lookup")
    n, held = right.agg(F.count("*"), F.coalesce(F.sum(_bytes(right)), F.lit(0))).first()
    if n <= rows and held <= BROADCAST:
        return left.join(F.broadcast(right), keys, "left").drop(weight)
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = right.where(F.col(weight) >= max(1000, total // 1000))
    values = [c for c in right.columns if c not in keys and c != weight]
    h = heavy.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.struct(*values).alias("_hv"))
    l = right.select(*[F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)], F.struct(*values).alias("_lv"))  # noqa: E741
    cond = lambda p: [F.col(k) == F.col(f"_{p}{i}") for i, k in enumerate(keys)]
    out = left.join(F.broadcast(h), cond("h"), "left").withColumn("_salt", F.when(F.col("_hv").isNotNull(), F.xxhash64(F.monotonically_increasing_id())))
    l = l.withColumn("_none", F.lit(0).cast("bigint"))  # noqa: E741
    out = out.join(l, [*cond("l"), F.coalesce("_salt", F.lit(0)) == F.col("_none")], "left")
    return out.select(*left.columns, *[F.coalesce(F.col("_hv")[v], F.col("_lv")[v]).alias(v) for v in values])


def ranked(d: DataFrame, order: list, name: str) -> DataFrame:
    """d with `name`: 1, 2, 3 ... in the order. Rows are numbered partition by partition along one sort."""
    d = stored(d.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    sizes = d.groupBy(F.shiftright("_id", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_p", before.alias("_before"))  # a row for each partition of the sort
    d = d.withColumn("_p", F.shiftright("_id", 33)).join(bounded_broadcast(sizes, 100_000), "_p")
    return d.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_p", "_id", "_before")
