"""Importance resampling towards a target corpus, by inverted postings that are partitioned by bucket.

A text's features (runs of words) are hashed into BUCKETS buckets. Where texts are read, each block of documents becomes
postings (bucket, document, count), packed by ranges of buckets, and each task's bucket totals. Totals of
both corpora meet bucket by bucket and give the buckets' gains; postings are shuffled by range and a part of the
blocks, so that a bucket that holds most postings is many tasks' work, and meet the gains of their range. What
a block's documents gain in a range goes on, and is added up by document. Documents with enough words are then ranked by
their mean gain and a Gumbel number made of their id (sampling without replacement), along one sort.

What leaves a task is counted per block, document and bucket first. Totals and gains have BUCKETS rows; the driver
gets the sums of both corpora, the number of blocks and that of documents to draw from.

Defined cases: null or empty text has no features (weight 0, no rank); a null id counts as empty text in the
seeded number; rows that share an id are judged apart; columns of any names may stand beside; an empty table
gives an empty result, an empty target corpus has no features; a very long text is counted whole, as a block
of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, parts, ranked, stored, table

#: Buckets, those of a row of postings, documents and features of a block, blocks of a part of a range.
BUCKETS, WIDTH, DOCS, FEATURES, PART = 10_000, 625, 4096, 1 << 19, 64
#: Letters and digits stay, A-Z in lower case; bytes from 0x80 on are letters. All others part words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ROWS = "block bigint, i int, doc_id {kind}, n_words bigint, n bigint, range int, docs binary, buckets binary, counts binary, totals array<bigint>"


def _buckets(words: list[bytes], longest: int) -> np.ndarray:
    """The bucket of each run of 1 to `longest` words."""
    n = len(words)
    runs = [np.fromiter(map(zlib.crc32, words), np.int64, n)]
    for k in range(2, longest + 1):
        runs.append(np.fromiter((zlib.crc32(b" ".join(words[i : i + k])) for i in range(n - k + 1)), np.int64, max(0, n - k + 1)))
    return np.concatenate(runs) % BUCKETS


def postings(docs: DataFrame, doc_id: str | None = "doc_id", text="text", longest: int = 1) -> DataFrame:
    """Rows of three kinds: documents (block, i, doc_id, n_words, n), postings (block, range, docs, buckets, counts)
    and a task's totals (range, totals). Without doc_id totals alone."""
    import pyarrow as pa

    kind = docs.schema[doc_id].dataType.simpleString() if doc_id else "bigint"
    d = docs.select((docs[f"`{doc_id}`"] if doc_id else F.lit(None).cast("bigint")).alias("doc_id"), docs[f"`{text}`"].alias("t"))

    def run(batches):
        first = block = TaskContext.get().partitionId() << 33
        totals = np.zeros(BUCKETS, np.int64)
        kinds = {"block": pa.int64(), "i": pa.int32(), "doc_id": None, "n_words": pa.int64(), "n": pa.int64(), "range": pa.int32(), "docs": pa.binary(), "buckets": pa.binary(), "counts": pa.binary(), "totals": pa.list_(pa.int64())}
        ids, words, sizes, keys = [], [], [], []
        held = 0

        def rows(_n, **cols):
            return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(_n, t) for c, t in kinds.items()], [*kinds])

        def done():
            yield rows(len(ids), block=[block] * len(ids), i=range(len(ids)), doc_id=ids, n_words=words, n=sizes)
            key, count = np.unique(np.concatenate(keys), return_counts=True)
            doc, bucket = key // BUCKETS, key % BUCKETS
            totals[:] += np.bincount(bucket, count, BUCKETS).astype(np.int64)
            part = bucket // WIDTH
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(BUCKETS // WIDTH + 1))
            out = []
            for r, (a, b) in enumerate(zip(ends, ends[1:])):
                if a < b:
                    o = order[a:b]
                    out.append((r, doc[o].astype("<u2").tobytes(), (bucket[o] - r * WIDTH).astype("<u2").tobytes(), count[o].astype("<u4").tobytes()))
            if out and doc_id:
                yield rows(len(out), block=[block] * len(out), range=[x[0] for x in out], docs=[x[1] for x in out], buckets=[x[2] for x in out], counts=[x[3] for x in out])
            for x in (ids, words, sizes, keys):
                x.clear()

        for b in parts(batches, 64, 256 << 10):
            kinds["doc_id"] = b.column("doc_id").type
            for who, t in zip(b.column("doc_id").to_pylist(), b.column("t").cast(pa.binary()).to_pylist(), strict=True):
                own = (t or b"").translate(FOLD).split()
                found = _buckets(own, longest)
                keys.append(found + len(ids) * BUCKETS)
                ids.append(who)
                words.append(len(own))
                sizes.append(len(found))
                held += len(found)
                if held >= FEATURES or len(ids) == DOCS:
                    yield from done()
                    block, held = block + 1, 0
        if ids:
            yield from done()
            block += 1
        if block > first:
            n = BUCKETS // WIDTH
            yield rows(n, range=range(n), totals=[*totals.reshape(n, WIDTH)])

    return d.mapInArrow(freed(run), ROWS.format(kind=kind))


def _totals(rows: DataFrame, name: str) -> DataFrame:
    """(bucket, name): the features of a corpus in each bucket."""
    d = rows.where("totals is not null").select("range", F.posexplode("totals").alias("k", "c"))
    return d.groupBy((F.col("range") * WIDTH + F.col("k")).alias("bucket")).agg(F.sum("c").alias(name))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """(range, gain): the gains of each range's buckets in their order, from both corpora's postings()."""
    both = stored(_totals(corpus, "s").join(_totals(target, "t"), "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "totals")
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(sums[0] + BUCKETS))
    down = (F.col("s") + 1).cast("double") * F.lit(float(sums[1] + BUCKETS))
    d = both.select(F.expr(f"cast(bucket div {WIDTH} as int)").alias("range"), "bucket", F.floor(1000 * F.log(up / down)).cast("long").alias("gain"))
    return d.groupBy("range").agg(F.expr("transform(array_sort(collect_list(struct(bucket, gain))), x -> x.gain)").alias("gain"))


def contributions(rows: DataFrame, gain: DataFrame) -> DataFrame:
    """(block, i, gained): what a block's documents gain in a range of buckets, from postings and the ranges' gains."""
    import pyarrow as pa

    own = rows.where("docs is not null").select("block", "range", "docs", "buckets", "counts")
    most = rows.where("n is not null").select("block").distinct().count() // PART
    own = own.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(most + 1)))
    gain = gain.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most).cast("long"))))

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for block, docs, buckets, counts, g in zip(*(b.column(c) for c in ("block", "docs", "buckets", "counts", "gain")), strict=True):
                doc = np.frombuffer(docs.as_buffer(), "<u2")
                got = g.values.to_numpy()[np.frombuffer(buckets.as_buffer(), "<u2")] * np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64)
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])  # postings of a document stand together
                out.append((np.full(len(first), block.as_py()), doc[first].astype(np.int32), np.add.reduceat(got, first)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["block", "i", "gained"])

    met = own.join(gain, ["range", "part"]).select("block", "docs", "buckets", "counts", "gain")
    return met.mapInArrow(freed(run), "block bigint, i int, gained bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, longest: int = 1, doc_id="doc_id", text="text", target_text="text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it isn't drawn."""
    rows = stored(postings(docs, doc_id, text, longest), "postings")
    gain = gains(rows, postings(target, None, target_text, longest))
    each = rows.where("n is not null").select("block", "i", "doc_id", "n_words", "n", F.lit(0).cast("long").alias("gained"))
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    got = contributions(rows, gain).select("block", "i", none("doc_id"), none("n_words"), none("n"), "gained")
    d = each.unionByName(got).groupBy("block", "i").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("_words"), F.max("n").alias("n_features"), F.sum("gained").alias("_g"))
    d = d.withColumn("weight", F.expr("if(n_features = 0, 0, (_g - pmod(_g, greatest(n_features, 1))) div greatest(n_features, 1))"))
    h = F.conv(F.substr(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), F.lit(1), F.lit(8)), 16, 10).cast("double")
    d = d.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long"))
    d = d.select("doc_id", "n_features", "weight", "score", (F.col("_words") >= least_words).alias("_may"))
    d = ranked(d, [F.desc("_may"), F.desc("score"), F.asc("doc_id")], "_rank")
    n = rows.where(F.col("n_words") >= least_words).count() * percent // 100
    return d.select("doc_id", "n_features", "weight", "score", F.when(F.col("_may") & (F.col("_rank") <= n), F.col("_rank")).alias("rank"))


def op13_importance(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
#: crc32 byte by byte over the different words, then sums by bucket and by document.
SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select {_WORDS} as w from benchmark),
dw as (select doc_id, unnest(w) as word from d), bw as (select unnest(w) as word from b),
tab as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
v as (select word, hex(word) as x from (select word from dw union select word from bw)),
hashed as (select word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: cast((strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1 as bigint))),
  lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) % 10000 as bucket from v, tab),
s as (select bucket, count(*) as s from dw join hashed using (word) group by bucket),
t as (select bucket, count(*) as t from bw join hashed using (word) group by bucket),
g as (select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from dw) + 10000)::double / ((coalesce(s, 0) + 1)::double * ((select count(*) from bw) + 10000)::double))) as bigint) as gain from s full join t using (bucket)),
e as (select doc_id, sum(gain) as got from dw join hashed using (word) join g using (bucket) group by doc_id),
f as (select doc_id, len(w) as n_features, case when len(w) = 0 then 0 else cast(floor(got::double / len(w)) as bigint) end as weight from d left join e using (doc_id)),
r as (select *, weight + cast(floor(-1000 * ln(-ln((cast('0x' || sha256('2024:' || doc_id)[1:8] as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score from f),
k as (select doc_id, row_number() over (order by score desc, doc_id) as rank from r where n_features >= 20)
select doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score, case when rank <= (select count(*) * 10 // 100 from k) then rank end as rank from r left join k using (doc_id)
"""
