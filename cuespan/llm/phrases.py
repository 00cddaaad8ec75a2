"""Phrase collocation mining: frequent phrases by passes with hashed buckets, then scores of their weakest cut.

Pass k counts the phrases of k words exactly, and in the same reading it counts the buckets into which the phrases of
k + 1 words are hashed. Counters of buckets stop at 255, so that a task's are a byte a bucket; they are added up by ranges of
buckets, and those that reach the least count become a bitmap, which is broadcast. In pass
k + 1 a phrase is counted only where its bucket's bit is set and both its parts of k words are frequent. For that, frequent
phrases are a bitmap of the same size, by their hashes. Bitmaps only ever let too much through, so counts are exact:
what is counted is the phrase's own text, per task first and then by Spark. From pass 2 on, words that are not
frequent part a piece; what is left of pieces is written in pass 2 and read by the later passes.

Everything is per language. Beside bitmaps, whose size is fixed, nothing goes through the driver; the tables of counts are
written to the shared folder. A task holds BLOCK words of each language and HELD phrases at most.

Defined cases: null or empty text has no words; a null language is `und`; repeated rows count each time;
columns of any names may stand beside; an empty table gives an empty result; of a very long text a task
takes blocks that end where a piece does; a piece is held whole.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, freed, parts, ranked, stored, table

#: Buckets of each pass (more of them tell more phrases apart in a larger corpus), the counters of a row, words of a block, phrases that a task holds, bytes of a row of left pieces.
BUCKETS, RANGE, BLOCK, HELD, ROW = 1 << 22, 1 << 14, 200_000, 300_000, 1 << 16
#: A byte that no UTF-8 text has: the end of a piece.
END = b"\xff"
FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + END * 10)
ROWS = "lang string, phrase string, c bigint, piece string, at int, places binary, counts binary"


def _mixed(h: np.ndarray, size: int) -> np.ndarray:
    """The bucket of each hash, of `size` ones, a power of two."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _next(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more."""
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    import xxhash

    seed = zlib.crc32(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


class Buckets:
    """Counters that stop at 255."""

    def __init__(self, size: int):
        self.counts = np.zeros(size, np.uint8)

    def add(self, hashes: np.ndarray, by: int = 1) -> None:
        if len(hashes):
            at, n = np.unique(_mixed(hashes, len(self.counts)), return_counts=True)
            self.counts[at] = np.minimum(255, self.counts[at] + n * by)

    def rows(self):
        """(range, places, counts) of the ranges that have any; places are null where most have."""
        for k in range(0, len(self.counts), RANGE):
            own = self.counts[k : k + RANGE]
            at = np.flatnonzero(own)
            if len(at) > RANGE // 4:
                yield k // RANGE, None, own.tobytes()
            elif len(at):
                yield k // RANGE, at.astype("<u2").tobytes(), own[at].tobytes()


class Bits:
    """A bitmap by buckets."""

    def __init__(self, packed: bytes):
        self.bits = np.frombuffer(packed, np.uint8)

    def __getitem__(self, hashes: np.ndarray) -> np.ndarray:
        buckets = _mixed(hashes, len(self.bits) * 8)
        return (self.bits[buckets >> 3] >> (7 - (buckets & 7)).astype(np.uint8)) & 1 == 1


def _bitmap(counters: DataFrame, least: int, size: int) -> bytes:
    """The bits of buckets whose counters reach `least`, from rows (at, places, counts); size / 8 bytes in all."""
    import pyarrow as pa

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for at, places, counts in zip(*(b.column(c).to_pylist() for c in ("at", "places", "counts")), strict=True):
                own = held.setdefault(at, np.zeros(RANGE, np.uint8))
                where = slice(None) if places is None else np.frombuffer(places, "<u2")
                own[where] = np.minimum(255, own[where].astype(np.int64) + np.frombuffer(counts, np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([*held], pa.int32()), pa.array([np.packbits(v >= least).tobytes() for v in held.values()], pa.binary())], ["at", "bits"])

    rows = counters.where("at is not null").select("at", "places", "counts")
    done = rows.repartition(size // RANGE, "at").mapInArrow(freed(add), "at int, bits binary").collect()
    out = bytearray(size // 8)
    for r in done:
        out[r.at * RANGE // 8 : (r.at + 1) * RANGE // 8] = r.bits
    return bytes(out)


class Pass:
    """What a task does in pass k with the words of one language."""

    def __init__(self, k: int, words: int, known: list[Bits], bucket: Bits | None, size: int):
        self.k, self.words, self.known, self.bucket = k, words, known, bucket
        self.buckets = Buckets(size)
        self.counts: dict[tuple[str, bytes], int] = {}
        self.seen: dict[str, int] = {}

    def block(self, lang: str, words: list[bytes], keep: bool) -> list[bytes]:
        """Counts the phrases of words, END parting pieces; with keep, what later passes need of the pieces.

        `words` is one language's; the last END closes it."""
        k, n = self.k, len(words)
        names = dict.fromkeys(words)
        for i, w in enumerate(names):
            names[w] = i
        ids = np.fromiter(map(names.__getitem__, words), np.int64, n)
        names = [*names]
        hashes = _word_hashes(names, lang)
        good = np.array([w != END for w in names]) if k == 1 else np.array([w != END for w in names]) & self.known[0][hashes]
        if k == 1:
            count = np.bincount(ids, minlength=len(names))
            self._add(lang, names, count * good)
            self.seen[lang] = self.seen.get(lang, 0) + int(count[good].sum())
        h1 = hashes[ids]
        h, at = h1, np.flatnonzero(good[ids])
        for j in range(2, k + 1):  # places of phrases of j words whose parts of j - 1 words are frequent
            at = at[:-1][at[1:] == at[:-1] + 1]
            h = _next(h[: n - j + 1], h1[j - 1 :])
            at = at[(self.known[j - 1] if j < k else self.bucket)[h[at]]]
        if k > 1 and len(at):
            code, size = ids[at], len(names)
            for j in range(1, k):
                if int(code.max()) + 1 > (1 << 62) // size:
                    code = np.unique(code, return_inverse=True)[1]
                code = code * size + ids[at + j]
            _, first, count = np.unique(code, return_index=True, return_counts=True)
            spots = at[first].tolist()
            self._add(lang, [b" ".join(words[p : p + k]) for p in spots], count)
        if k < self.words:
            more = at[:-1][at[1:] == at[:-1] + 1]
            h = _next(h[: n - k], h1[k:])
            self.buckets.add(h[more])
        return self._left(words, at) if keep else []

    def _left(self, words: list[bytes], at: np.ndarray) -> list[bytes]:
        """The words in runs of two or more neighbouring phrases, as texts of one piece each."""
        if not len(at):
            return []
        cut = np.flatnonzero(np.diff(at) != 1) + 1
        lo, hi = at[np.r_[0, cut]], at[np.r_[cut, len(at)] - 1]
        return [b" ".join(words[a : b + self.k]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b > a]

    def _add(self, lang: str, phrases: list[bytes], counts: np.ndarray) -> None:
        own = self.counts
        for p, c in zip(phrases, counts.tolist(), strict=True):
            if c:
                own[lang, p] = own.get((lang, p), 0) + c


def _counted(texts: DataFrame, k: int, words: int, known: list, bucket, keep: bool, size: int) -> DataFrame:
    """Pass k over texts (lang, t): rows of ROWS, phrases with counts, counters of buckets, and left pieces.

    In pass 1 a null phrase counts all words of its language."""
    import pyarrow as pa

    def run(batches):
        me = Pass(k, words, [Bits(x.value) for x in known], Bits(bucket.value) if bucket else None, size)
        held: dict[str, list[bytes]] = {}

        def rows(**cols):
            n = len(next(iter(cols.values())))
            kinds = {"lang": pa.string(), "phrase": pa.string(), "c": pa.int64(), "piece": pa.string(), "at": pa.int32(), "places": pa.binary(), "counts": pa.binary()}
            text = {"phrase", "piece"}
            return pa.RecordBatch.from_arrays([(pa.array(cols[c], pa.binary()).cast(pa.string()) if c in text else pa.array(cols[c], t)) if c in cols else pa.nulls(n, t) for c, t in kinds.items()], [*kinds])

        def done(lang):
            pieces = me.block(lang, held.pop(lang), keep)
            long, row = 0, []
            for p in [*pieces, None]:
                if row and (p is None or long > ROW):
                    yield rows(lang=[lang], piece=[b"\n".join(row)])
                    long, row = 0, []
                if p is not None:
                    row.append(p)
                    long += len(p)
            if len(me.counts) > HELD:
                yield counts()

        def counts():
            keys = [*me.counts]
            out = rows(lang=[x for x, _ in keys], phrase=[p for _, p in keys], c=[*me.counts.values()])
            me.counts.clear()
            return out

        for b in parts(batches, 64, 256 << 10):
            for lang, t in zip(b.column("lang").to_pylist(), b.column("t").cast(pa.binary()).to_pylist(), strict=True):
                if not t:
                    continue
                own = t.translate(FOLD).replace(END, b" \xff ").split()
                own.append(END)
                while len(own) > BLOCK:  # a cut at the end of a piece, so that no phrase lies over it
                    cut = next((i for i in range(BLOCK, 0, -1) if own[i - 1] == END), 0) or next(i for i, w in enumerate(own, 1) if w == END)
                    held.setdefault(lang, []).extend(own[:cut])
                    own = own[cut:]
                    yield from done(lang)
                if own:
                    held.setdefault(lang, []).extend(own)
                if len(held.get(lang, ())) > BLOCK:
                    yield from done(lang)
        for lang in [*held]:
            yield from done(lang)
        yield counts()
        if me.seen:
            yield rows(lang=[*me.seen], c=[*me.seen.values()])
        if k < words:
            if found := [*me.buckets.rows()]:
                yield rows(at=[x[0] for x in found], places=[x[1] for x in found], counts=[x[2] for x in found])

    return texts.mapInArrow(freed(run), ROWS)


def _known_bits(frequent: DataFrame, k: int, size: int) -> bytes:
    """The bitmap of frequent phrases (lang, phrase) of k words."""
    import pyarrow as pa

    def run(batches):
        own = Buckets(size)
        for b in batches:
            by: dict[str, list[list[bytes]]] = {}
            for lang, p in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), strict=True):
                by.setdefault(lang, []).append(p.encode().split(b" "))
            for lang, phrases in by.items():
                h = _word_hashes([p[0] for p in phrases], lang)
                for j in range(1, k):
                    h = _next(h, _word_hashes([p[j] for p in phrases], lang))
                own.add(h, 255)
        found = [*own.rows()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), *(pa.array([x[i] for x in found], pa.binary()) for i in (1, 2))], ["at", "places", "counts"])

    return _bitmap(frequent.select("lang", "phrase").mapInArrow(freed(run), "at int, places binary, counts binary"), 255, size)


def frequent_phrases(docs: DataFrame, least: int = 100, words: int = 5, text="text", lang="lang", buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of all phrases of 1 to `words` words that occur `least` times (255 at most) or more, and
    (lang, n), the number of all words."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    if not 0 < least <= 255 or buckets < RANGE or buckets & (buckets - 1):
        raise ValueError(f"least must be 1 to 255, and buckets a power of two from {RANGE} on")
    texts = docs.select(F.coalesce(docs[f"`{lang}`"].cast("string"), F.lit("und")).alias("lang"), docs[f"`{text}`"].alias("t"))
    known, bucket, out, total = [], None, None, None
    for k in range(1, words + 1):
        made = stored(_counted(texts, k, words, known, bucket, k == 2 and words > 2, buckets), f"pass{k}")
        sums = made.where("c is not null").groupBy("lang", "phrase").agg(F.sum("c").alias("f")).where((F.col("f") >= least) | F.col("phrase").isNull())
        sums = stored(sums.select("lang", F.lit(k).alias("k"), "phrase", "f"), f"frequent{k}")
        own = sums.where("phrase is not null")
        if k == 1:
            total = sums.where("phrase is null").select("lang", F.col("f").alias("n"))
        out = own if out is None else out.unionByName(own)
        if k == words:
            break
        bucket = sc.broadcast(_bitmap(made, least, buckets))
        known.append(sc.broadcast(_known_bits(own, k, buckets)))
        if k == 2:
            texts = made.where("piece is not null").select("lang", F.col("piece").alias("t"))
    return out, total


def collocations(docs: DataFrame, least: int = 100, words: int = 5, best: int = 2000, scale: int = 1000, inside: int = 100, text="text", lang="lang", buckets: int = BUCKETS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `best` phrases by their weakest cut.

    A cut's score is floor(scale * a * n / (l * r)), in decimals of 38 digits. A phrase goes if one of a word more around it has
    `inside` hundredths of its count; one of two words more has no higher count than that of one more between them."""
    f, n = frequent_phrases(docs, least, words, text, lang, buckets)
    c = f.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"))
    # what a longer phrase holds
    tail = lambda p: F.substr(p, F.length(F.substring_index(p, " ", 1)) + 2)
    ends = c.where("k > 2").select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), tail(F.col("phrase")))).alias("phrase"), "a")
    over = ends.groupBy("lang", "phrase").agg(F.max("a").alias("_over"))
    left = c.join(over, ["lang", "phrase"], "left").where(f"_over is null or 100 * _over < {inside} * a").drop("_over")
    # cuts and the counts of both parts
    cuts = left.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumn("first", F.expr("substring_index(phrase, ' ', cut)"))
    cuts = cuts.withColumn("rest", F.substr("phrase", F.length("first") + 2))
    part = lambda name, count: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = cuts.join(bounded_broadcast(n, 100_000), "lang")
    big = lambda x: f"cast({x} as decimal(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"({scale} * ({big('a')} * {big('n')})) div ({big('l')} * {big('r')})"))
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    d = weakest.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")
    d = ranked(d, [F.asc("lang"), F.desc("score"), F.desc("a"), F.asc("phrase")], "_place")
    first = stored(d.groupBy("lang").agg(F.min("_place").alias("_first")), "first")
    d = d.join(bounded_broadcast(first, 100_000), "lang").withColumn("rank", F.col("_place") - F.col("_first") + 1).where(F.col("rank") <= best)
    return d.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: Every phrase of every length counted plainly.
SQL = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from w, range(1, 6) as r(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as f from g group by all having count(*) >= 100),
n as (select lang, sum(len(w)) as n from w group by lang),
c as (select lang, k, phrase, f as a from f where k > 1),
o as (select lang, phrase, max(a) as m from (
  select lang, array_to_string(string_split(phrase, ' ')[:-2], ' ') as phrase, a from c where k > 2
  union all select lang, array_to_string(string_split(phrase, ' ')[2:], ' ') as phrase, a from c where k > 2) group by all),
kept as (select c.* from c left join o using (lang, phrase) where m is null or 100 * m < 100 * a),
cuts as (select lang, phrase, a, k, cut, array_to_string(string_split(phrase, ' ')[:cut], ' ') as first, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') as rest from kept, range(1, 5) as r(cut) where cut < k),
s as (select cuts.lang, cuts.phrase, a, cut, x.f as l, y.f as r, n, (1000 * a::hugeint * n::hugeint) // (x.f::hugeint * y.f::hugeint) as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = cuts.first join f y on y.lang = cuts.lang and y.phrase = cuts.rest join n on n.lang = cuts.lang),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, rank, phrase, a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b) where rank <= 2000
"""
