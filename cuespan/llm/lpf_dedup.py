"""Removal of repeated byte strings by longest previous factors.

A byte goes if some SPAN-byte string over it also starts earlier (smaller id, or earlier in the same
document); the first copy stays. No match crosses documents.

1. Anchors. Each window of SPAN - GRAM + 1 neighbouring GRAM-byte hashes keeps its least one, so any two
   equal SPAN-byte strings hold an equal anchor at the same place. About one byte in 35 is an anchor.
   With its hash goes a hash of its context, all bytes that a SPAN-byte string over the anchor can reach;
   together they are 128 bits, by which equal contexts are told.
2. Anchors are dealt by hash as packed arrays. Of equal contexts all but the first are copies outright;
   that is also done within each map task's runs before the shuffle, so a string that is copied often
   sends one entry for each run. Anchors with several different contexts need their bytes compared.
3. Those contexts are dealt by anchor. Each task builds the suffix array of its contexts by prefix doubling
   and the array of longest common prefixes. From the previous and the next smaller place in suffix order
   follows the longest previous factor at each place; factors of SPAN bytes or more are later copies.
4. Copied places are merged for each document and cut out.

Hot anchors (of boilerplate in a large share of all documents) are never brought together, not even to be
counted: an estimate from one document in SAMPLE names them, and each is dealt by its contexts' hashes. It
decides only where entries meet. The SPAN-byte strings over hot anchors are compared by 128-bit hashes, first
within runs, and dealt by those, as a suffix array would need all of an anchor's contexts in one task.

Every join of documents with their places is a shuffle join by id, at any size. A task of the first meeting
holds a bounded number of entries: beyond HELD bytes they go to a file of the task and are read back by
ranges of hashes. Defined cases: null is as empty; texts under SPAN bytes keep all; rows with the same id
and text get the same result, as one document; different texts under one id are documents of their own, in
order of their hashes; a null id counts as the smallest; columns of any names may stand beside; a very long text is
one document, whose anchors are dealt like others'; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, lookup, stored, table, text_hash, text_keys

SPAN, GRAM, NO_ID = 100, 32, -(1 << 63)
#: Hot anchors: one document in SAMPLE is looked at; HOT different contexts there make an anchor hot, the MOST_HOT ones with the most.
SAMPLE, HOT, MOST_HOT = 64, 64, 500_000
SIDE = SPAN - GRAM
#: Entries that travel: two hashes, document, and the place.
ENTRY = np.dtype([("h", "<u8"), ("c", "<u8"), ("id", "<i8"), ("at", "<i4"), ("to", "<i4")])
#: Places of a document; kind 0: a copied range, 1: an anchor to compare, 2: a heavy anchor.
PLACE = np.dtype([("id", "<i8"), ("at", "<i4"), ("to", "<i4"), ("kind", "<i4"), ("h", "<u8")])
#: What documents get to know: ranges to cut, or anchors to compare.
RANGE = np.dtype([("at", "<i4"), ("to", "<i4")])
ASKED = np.dtype([("h", "<u8"), ("at", "<i4"), ("to", "<i4"), ("kind", "<i1")])
#: A context that is compared: its anchor's hash, document, first byte and size.
CONTEXT = np.dtype([("h", "<u8"), ("id", "<i8"), ("at", "<i4"), ("size", "<i4")])
BLOCK_BYTES, BUCKET_BYTES, MOST_BUCKETS = 1 << 20, 32 << 20, 1 << 18
#: Entries that a map task gathers before it sends them, bytes that a meeting holds in memory, entries that it sorts at once.
RUN, HELD, SORTED = 1 << 19, 256 << 20, 1 << 21
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LEVEL = np.random.default_rng(12).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(data: np.ndarray) -> np.ndarray:
    """A mixed hash of the GRAM bytes at each place."""
    h, size, k = _TABLE[data], 1, 0
    while size < GRAM:
        h = h[:-size] * _LEVEL[k] + h[size:]
        size, k = size * 2, k + 1
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every width neighbours."""
    size = 1
    while size * 2 <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text of SPAN bytes or more."""
    g = grams(data)
    least = _slide(g, SIDE + 1, np.minimum)
    none = np.zeros(SIDE, np.uint64)
    at = np.flatnonzero(_slide(np.r_[none, least, none], SIDE + 1, np.maximum) == g)
    return at, g[at]


def _firsts(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries sorted by hashes and place; whether each is the first of its pair of hashes."""
    e = e[np.lexsort((e["at"], e["id"], e["c"], e["h"]))]
    first = np.r_[True, (e["h"][1:] != e["h"][:-1]) | (e["c"][1:] != e["c"][:-1])] if len(e) else np.empty(0, bool)
    return e, first


def _copies(e: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ranges of entries that are not the first place of their pair of hashes."""
    if not len(e):
        return np.empty(0, PLACE)
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    own = (e["id"] != e["id"][lead]) | (e["at"] != e["at"][lead])
    return _places(e["id"][own], e["at"][own], e["to"][own], 0)


def _places(ids, at, to, kind, h=0) -> np.ndarray:
    p = np.empty(len(ids), PLACE)
    p["id"], p["at"], p["to"], p["kind"], p["h"] = ids, at, to, kind, h
    return p


def merged(p: np.ndarray) -> np.ndarray:
    """Ranges of each document, sorted, with those that touch made one."""
    if not len(p):
        return p
    p = p[np.lexsort((p["to"], p["at"], p["id"]))]
    new_id = np.r_[True, p["id"][1:] != p["id"][:-1]]
    lift = (np.cumsum(new_id) - 1).astype(np.int64) << 33  # so that ranges of later documents lie beyond
    a, b = p["at"] + lift, np.maximum.accumulate(p["to"] + lift)
    cut = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    out = p[cut].copy()
    out["to"] = (b[np.r_[cut[1:] - 1, len(b) - 1]] - lift[cut]).astype(np.int32)
    return out


def _packed(parts: dict[str, tuple[np.ndarray, np.ndarray]], names=("bucket", "entries", "places")):
    """A record batch of blobs: for each bucket and kind the raw rows of a structured array."""
    import pyarrow as pa

    rows = []
    for kind, (x, to) in parts.items():
        at = np.argsort(to, kind="stable")
        x, to = x[at], to[at]
        cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(x) else []
        rows += [(int(to[c]), kind, s.tobytes()) for c, s in zip(cut, np.split(x, cut[1:]) if len(x) else [], strict=True)]
    return pa.RecordBatch.from_pydict({names[0]: pa.array([r[0] for r in rows], pa.int32()), **{n: pa.array([r[2] if r[1] == n else None for r in rows], pa.binary()) for n in names[1:]}})


def _joined(blobs: list, kind: np.dtype) -> np.ndarray:
    blobs = [b for b in blobs if b]
    return np.frombuffer(b"".join(blobs), kind) if blobs else np.empty(0, kind)


def _home(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of documents, evenly dealt."""
    h = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)


def _smaller(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix, in suffix order, the common prefix with the nearest suffix before it of a smaller place;
    0 where that is under SPAN. lcp: common prefix with the suffix before.

    Each points at the one before; who points at no smaller place takes over where that one points, and the
    least common prefix on the way. All do so at once, so ways shorten by half."""
    to, least = np.arange(-1, len(place) - 1), np.where(lcp >= SPAN, lcp, 0)
    while True:
        bad = np.flatnonzero(least > 0)
        bad = bad[place[to[bad]] >= place[bad]]
        if not len(bad):
            return least
        over = to[bad]
        to[bad], least[bad] = to[over], np.minimum(least[bad], least[over])


def previous_factors(contexts: list[bytes], ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, place, longest previous factor) of all places in the contexts where SPAN bytes follow; a factor under
    SPAN is 0, and factors end with their context."""
    size = np.array([len(c) for c in contexts])
    end = np.cumsum(size + 1) - 1  # each context ends with a sign below all bytes
    data = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8).astype(np.uint64) + np.uint64(1)
    data[end] = 0
    data = np.r_[data, np.zeros(256, np.uint64)]
    n = len(data) - 64
    word = np.zeros(n, np.uint64)
    for k in range(7):  # seven signs of nine bits from each place as one number
        word = (word << np.uint64(9)) | data[k : k + n]
    ranks = lambda x: np.unique(x, return_inverse=True)[1].astype(np.uint32)
    pairs = lambda x, y: (x.astype(np.uint64) << np.uint64(32)) | y
    rank = {7: ranks(word)}
    del word
    for step in (7, 14, 28):  # ranks of 14, 28, 56 signs
        rank[2 * step] = np.r_[ranks(pairs(rank[step][:-step], rank[step][step:])), np.zeros(step, np.uint32)]
    count = np.maximum(size - SPAN + 1, 0)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(end - size, count) + inner  # where a whole SPAN-byte string starts
    left = np.repeat(size, count) - inner
    own, place = np.repeat(ids, count), np.repeat(starts, count) + inner
    order = np.lexsort((rank[56][at + 112], pairs(rank[56][at], rank[56][at + 56])))  # by whole contexts
    at, left, own, place = at[order], left[order], own[order], place[order]
    new = np.lexsort((place, own))
    of = np.empty(len(at), np.int64)  # the place among all of the block, equal for the same place
    of[new] = np.cumsum(np.r_[False, (own[new][1:] != own[new][:-1]) | (place[new][1:] != place[new][:-1])]) if len(at) else 0
    a, b = at[:-1], at[1:]
    lcp = np.zeros(len(a), np.int64)
    for step in (56, 56, 28, 14, 7):
        lcp += step * (rank[step][a + lcp] == rank[step][b + lcp])
    same = np.ones(len(a), bool)
    for _ in range(6):
        same &= data[a + lcp] == data[b + lcp]
        lcp += same
    lcp = np.minimum(lcp, np.minimum(left[:-1], left[1:]))
    before = _smaller(of, np.r_[0, lcp][: len(at)])
    after = _smaller(of[::-1], np.r_[0, lcp[::-1]][: len(at)])[::-1]
    return own, place, np.maximum(before, after)


def later_copies(contexts: list[bytes], ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranges of the contexts' later copies, by their longest previous factors."""
    own, place, factor = previous_factors(contexts, ids, starts)
    own, place, factor = own[factor > 0], place[factor > 0], factor[factor > 0]
    return merged(_places(own, place, place + factor, 0))


class Held:
    """Packed entries, each blob sorted by hash; beyond a bound they lie in a file of the task."""

    def __init__(self, kind: np.dtype):
        self.kind, self.blobs, self.size, self.file, self.cuts = kind, [], 0, None, []

    def add(self, blob: bytes | None) -> None:
        if not blob:
            return
        self.blobs.append(blob)
        self.size += len(blob)
        if self.size > HELD:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for b in self.blobs:
            self.cuts.append((self.file.tell() // self.kind.itemsize, len(b) // self.kind.itemsize))
            self.file.write(b)
        self.blobs, self.size = [], 0

    def ranges(self):
        """Arrays of all entries in ranges of hashes, each about SORTED entries long; no hash is in two."""
        parts = [np.frombuffer(b, self.kind) for b in self.blobs]
        if self.file is not None:
            self.file.flush()
            whole = np.memmap(self.file, self.kind, mode="r")
            parts += [whole[a : a + n] for a, n in self.cuts]
        total = sum(map(len, parts))
        k = -(-total // SORTED)
        edges = [0, *[(1 << 64) // k * i for i in range(1, k)]]
        for lo, hi in zip(edges, [*edges[1:], None], strict=True) if total else []:
            own = [p[np.searchsorted(p["h"], np.uint64(lo)) : np.searchsorted(p["h"], np.uint64(hi)) if hi is not None else len(p)] for p in parts]
            yield np.concatenate(own)


def _entries(raw: bytes, i: int) -> np.ndarray:
    """The anchors of one text of SPAN bytes or more, with their contexts' hashes."""
    from xxhash import xxh3_64_intdigest

    at, h = anchors(np.frombuffer(raw, np.uint8))
    e = np.empty(len(at), ENTRY)
    lo, hi = np.maximum(at - SIDE, 0), np.minimum(at + SPAN, len(raw))
    e["h"], e["id"], e["at"], e["to"] = h, i, lo, hi
    e["c"] = [xxh3_64_intdigest(raw[x:y], z) for x, y, z in zip(lo.tolist(), hi.tolist(), (at - lo).tolist(), strict=True)]
    return e


def _runs(batches, of_row):
    """Structured arrays of RUN entries or somewhat more, of the rows (id, t, ...) of record batches."""
    parts, size = [], 0
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            e = of_row(*row)
            if e is not None and len(e):
                parts.append(e)
                size += len(e)
            if size >= RUN:
                yield np.concatenate(parts)
                parts, size = [], 0
    if parts:
        yield np.concatenate(parts)


def _anchored(i: int, t: str | None) -> np.ndarray | None:
    raw = (t or "").encode()
    return _entries(raw, i) if len(raw) >= SPAN else None


def hot_anchors(d: DataFrame, least: int = HOT) -> np.ndarray:
    """Hashes of anchors with many different contexts, by an estimate; the MOST_HOT hottest."""
    import pyarrow as pa

    def count(batches):
        for e in _runs(batches, _anchored):
            e, first = _firsts(e)
            h, n = np.unique(e["h"][first], return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": h.view(np.int64)[n > 1], "n": n[n > 1]})

    of = d.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).mapInArrow(freed(count), "h bigint, n bigint")
    hot = of.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(MOST_HOT).select("h").collect()
    return np.sort(np.array([r[0] for r in hot], np.int64).view(np.uint64))


def _among(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(h), bool)
    return hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h


def marks(d: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Rows (bucket, places): the anchors' copies and those to compare, packed by the documents' home bucket."""
    sent = d.sparkSession.sparkContext.broadcast(hot)

    def find(batches):
        for e in _runs(batches, _anchored):
            e, first = _firsts(e)
            copies = merged(_copies(e, first))
            e = e[first]
            to = _bucket(np.where(_among(e["h"], sent.value), e["c"], e["h"]), buckets)
            yield _packed({"entries": (e, to), "places": (copies, _home(copies["id"], buckets))})

    def meet(batches):
        held, done = Held(ENTRY), []
        for b in batches:
            for blob in b.column("entries").to_pylist():
                held.add(blob)
            done += b.column("places").to_pylist()
        p = merged(_joined(done, PLACE))
        yield _packed({"places": (p, _home(p["id"], buckets))})
        for e in held.ranges():
            e, first = _firsts(e)
            copies = merged(_copies(e, first))
            e = e[first]
            cut = np.flatnonzero(np.r_[True, e["h"][1:] != e["h"][:-1]])
            many = np.diff(np.r_[cut, len(e)])
            hot = _among(e["h"], sent.value)
            ask = (np.repeat(many, many) > 1) | hot
            p = np.concatenate([copies, _places(e["id"][ask], e["at"][ask], e["to"][ask], np.where(hot[ask], 2, 1), e["h"][ask])])
            yield _packed({"places": (p, _home(p["id"], buckets))})

    return d.mapInArrow(freed(find), "bucket int, entries binary, places binary").repartition(buckets, "bucket").mapInArrow(freed(meet), "bucket int, entries binary, places binary").select("bucket", "places")


def by_document(places: DataFrame, buckets: int, kinds: tuple[int, ...]) -> DataFrame:
    """One row (id, places) for each document with places of these kinds: merged ranges, or anchors as they are."""
    import pyarrow as pa

    def gather(batches):
        p = _joined([x for b in batches for x in b.column("places").to_pylist()], PLACE)
        p = p[np.isin(p["kind"], kinds)]
        p = merged(p) if kinds == (0,) else np.unique(p)
        cut = np.flatnonzero(np.r_[True, p["id"][1:] != p["id"][:-1]]) if len(p) else np.empty(0, int)
        end = np.r_[cut[1:], len(p)]
        kind = RANGE if kinds == (0,) else ASKED
        short = np.empty(len(p), kind)
        for f in kind.names:
            short[f] = p[f]
        for k in range(0, len(cut), 2000):
            c, z = cut[k : k + 2000], end[k : k + 2000]
            yield pa.RecordBatch.from_pydict({"id": np.ascontiguousarray(p["id"][c]), "places": pa.array([short[x:y].tobytes() for x, y in zip(c, z, strict=True)], pa.binary())})

    return places.repartition(buckets, "bucket").mapInArrow(freed(gather), "id bigint, places binary")


def compared(d: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, places) of later copies around the anchors to compare; d: rows (id, t, places)."""
    import pyarrow as pa

    def cut(batches):
        from xxhash import xxh3_128_intdigest

        for b in batches:
            meta, bits, strings = [], [], []
            for i, t, blob in zip(*[b.column(c).to_pylist() for c in ("id", "t", "places")], strict=True):
                raw, p = (t or "").encode(), np.frombuffer(blob, ASKED)
                p = p[p["to"] <= len(raw)]
                calm, hot = p[p["kind"] == 1], p[p["kind"] == 2]
                m = np.empty(len(calm), CONTEXT)
                m["h"], m["id"], m["at"], m["size"] = calm["h"], i, calm["at"], calm["to"] - calm["at"]
                meta.append(m)
                bits += [raw[x:y] for x, y in zip(calm["at"].tolist(), calm["to"].tolist(), strict=True)]
                at = np.unique(np.concatenate([np.arange(x, y - SPAN + 1) for x, y in zip(hot["at"].tolist(), hot["to"].tolist(), strict=True)] or [np.empty(0, int)]))
                e = np.empty(len(at), ENTRY)
                wide = [xxh3_128_intdigest(raw[x : x + SPAN]) for x in at.tolist()]
                e["h"], e["c"] = [x >> 64 for x in wide], [x & 0xFFFFFFFFFFFFFFFF for x in wide]
                e["id"], e["at"], e["to"] = i, at, at + SPAN
                strings.append(e)
            e, first = _firsts(np.concatenate(strings) if strings else np.empty(0, ENTRY))
            copies = merged(_copies(e, first))
            out = _packed({"entries": (e[first], _bucket(e["h"][first], buckets)), "places": (copies, _home(copies["id"], buckets))})
            yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.binary()), pa.nulls(out.num_rows, pa.binary())], [*out.schema.names, "meta", "data"])
            m = np.concatenate(meta) if meta else np.empty(0, CONTEXT)
            to = _bucket(m["h"], buckets)
            rows = []
            for k in np.unique(to).tolist():
                own = np.flatnonzero(to == k)
                rows.append((k, m[own].tobytes(), b"".join([bits[x] for x in own.tolist()])))
            none = pa.nulls(len(rows), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), none, none, pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], [*out.schema.names, "meta", "data"])

    def meet(batches):
        cols: dict[str, list] = {"entries": [], "places": [], "meta": [], "data": []}
        for b in batches:
            for c, x in cols.items():
                x += [v for v in b.column(c).to_pylist() if v]
        e, first = _firsts(_joined(cols["entries"], ENTRY))
        found = [_copies(e, first), _joined(cols["places"], PLACE)]
        m = _joined(cols["meta"], CONTEXT)
        data = b"".join(cols["data"])
        start = np.cumsum(m["size"], dtype=np.int64) - m["size"]
        order = np.argsort(m["h"], kind="stable")
        m, start = m[order], start[order]
        # blocks of whole anchors
        ends = np.flatnonzero(np.r_[m["h"][1:] != m["h"][:-1], True]) + 1 if len(m) else []
        lo, held = 0, 0
        total = np.cumsum(m["size"], dtype=np.int64)
        for end in ends:
            held = total[end - 1] - (total[lo - 1] if lo else 0)
            if held >= BLOCK_BYTES or end == len(m):
                own = slice(lo, end)
                found.append(later_copies([data[x : x + n] for x, n in zip(start[own].tolist(), m["size"][own].tolist(), strict=True)], m["id"][own], m["at"][own]))
                lo = end
        p = merged(np.concatenate(found))
        yield _packed({"places": (p, _home(p["id"], buckets))})

    four = "bucket int, entries binary, places binary, meta binary, data binary"
    return d.select("id", "t", "places").mapInArrow(freed(cut), four).repartition(buckets, "bucket").mapInArrow(freed(meet), "bucket int, entries binary, places binary").select("bucket", "places")


def removed(docs: DataFrame, doc_id="doc_id", text="text", hot: int = HOT) -> DataFrame:
    """Rows (id, places) of documents that lose bytes; places: merged ranges of bytes, as RANGE."""
    spark = docs.sparkSession
    d = docs.select(F.coalesce(docs[f"`{doc_id}`"].cast("bigint"), F.lit(NO_ID)).alias("id"), docs[f"`{text}`"].alias("t"))
    size = d.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // BUCKET_BYTES + 1, MOST_BUCKETS))
    found = stored(marks(d, buckets, hot_anchors(d, hot)), "marks")
    asked = by_document(found, buckets, (1, 2))
    near = compared(d.where(F.octet_length("t") >= SPAN).join(asked.hint("merge"), "id"), buckets)
    both = found.unionByName(near)
    return stored(by_document(both, buckets, (0,)), "removed")


def cleaned(docs: DataFrame, doc_id="doc_id", text="text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row; kept: the bytes that stay."""
    import pyarrow as pa

    d = docs.select(docs[f"`{doc_id}`"].cast("bigint").alias("doc_id"), docs[f"`{text}`"].alias("t")).withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    keys = text_keys(d)
    if keys is not None:
        d = lookup(d.withColumn("th", text_hash(F.col("t"))), keys, ["id", "th"], "c")
        d = stored(d.select("doc_id", "t", F.col("key").alias("id")), "keyed")
    cut = removed(d, "id", "t", hot)
    d = d.join(cut.hint("merge"), "id", "left").select("doc_id", "t", "places")

    def run(batches):
        for b in batches:
            rows = []
            for i, t, blob in zip(*[b.column(c).to_pylist() for c in ("doc_id", "t", "places")], strict=True):
                raw = (t or "").encode()
                p = np.frombuffer(blob, RANGE) if blob else np.empty(0, RANGE)
                p = p[p["at"] < len(raw)]
                at, to = p["at"].tolist(), np.minimum(p["to"], len(raw)).tolist()
                kept = b"".join([raw[x:y] for x, y in zip([0, *to], [*at, len(raw)], strict=True)])
                rows.append((i, len(raw), len(raw) - len(kept), len(at), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return d.mapInArrow(freed(run), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op7_lpf_dedup(spark, sf_dir: str) -> DataFrame:
    return cleaned(table(spark, sf_dir, "documents")).drop("kept")
