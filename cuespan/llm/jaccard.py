"""Documents whose sets of word shingles have a Jaccard similarity of 0.75 or more, by signature trees.

1. Each text becomes the set of its five-word shingles (64-bit hashes), written with its size, a digest
   of the whole set and a bitmap of its tokens. Equal sets (128-bit digests) are one node, named by their
   least id.
2. Signature trees hold sets: sorted by size and bitmap, each level keeps the OR of the bitmaps below, the
   range of sizes and the largest number of tokens that share a bit. A dual traversal drops pairs of tree
   nodes whose size ranges or largest possible overlap rule 0.75 out, from the roots down to pairs of sets.
   All trees of a task are levels of one forest, so one traversal works on all of them at once.
3. First round: the nodes that share a least shingle with a common hub stand in one tree, which is traversed
   against the hub's. Pairs that are left are compared exactly. So a group of copies costs its size, not its
   square, and links most copies to one hub.
4. Second round, for links between what the first left apart. Shingles are put in one order, rare before
   frequent ones, then by hash. Sets that reach 0.75 share at least k + 1 shingles among their first
   n - ceil(0.75 n) + 1 + k (prefix rule; k is n / 10 here). Prefixes travel as packed arrays, dealt by
   shingle; only shingles that nodes of different components share go on. Frequent shingles come last in the
   order and send one entry for each component and run, so no hot shingle gathers its documents in a task.
   Documents that have too few shared shingles left for any partner go.
5. Nodes that share such a shingle form a tree, which is traversed against itself; a large group is cut into
   blocks, and the trees of every two blocks are traversed in a place of their own, which also has its documents'
   whole sets. Pairs inside a known component are never made.
6. Surviving pairs are compared exactly, set against set: those of the first round streamed by partner, those of the
   second in their place, which sends the links that tie components it hasn't tied yet, so fewer than it has documents.
   Components follow by contraction.

Shingles are compared by 64-bit hashes of hashes of words: exact but for collisions of those.

Defined cases: null and empty texts have no shingle and no link; texts of fewer than five words are one
shingle; texts under one id are nodes of their own, equal rows are one node and get a row each; a null id gets its
count and a null component; columns of any names may stand beside; a very long text is one set, made in one task;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, freed, lookup, parts, stored, table, text_hash, text_keys
from .components import components

WORDS, BITS, FAN, BLOCK, GATHER, QUICK, RARE, PART, KNOWN = 5, 1024, 8, 1024, 50_000, 8, 200, 8192, 50_000
#: Bits of the bitmaps by which a place of the second round compares its sets.
WIDE = 1 << 15
#: A shingle of more than HEAVY documents is frequent, at any size; the MOST_HEAVY of them with the most documents are told apart.
HEAVY, MOST_HEAVY = 500, 200_000
#: Entries of prefixes that a map task gathers before it sends them; buckets that they are dealt to at most.
RUN, MOST_BUCKETS = 1 << 18, 1 << 18
#: Odd multipliers of the shingle hash.
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
TOP = np.uint64(1 << 63)


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self):
        import xxhash

        self._hash = xxhash.xxh64_intdigest
        self.known: dict[bytes, int] = {}

    def _words(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        known = self.known
        new = set(words).difference(known)
        for w in new:
            known[w] = self._hash(w)
        out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > KNOWN:  # full: the frequent words came early and stay
            for w in new:
                del known[w]
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        w = self._words(text)
        n = len(w)
        if n == 0:
            return w
        with np.errstate(over="ignore"):
            if n < WORDS:
                h = np.array([(w * _MULT[:n]).sum() + np.uint64(n)], np.uint64)
            else:
                h = w[: n - 4] * _MULT[0]
                for k in range(1, WORDS):
                    h = h + w[k : n - 4 + k] * _MULT[k]
            h ^= h >> np.uint64(33)
            h *= np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
        return np.unique(h)


def shared_least(n):
    """How many shingles of their prefixes two sets that link share at least, by the smaller set's size."""
    return 1 + n // 10


def prefix(n: int) -> int:
    """How many first shingles of a set of n count: a linking set keeps 0.75 n of them at least, so prefixes
    that are longer by k share 1 + k."""
    return min(n, n - (3 * n + 3) // 4 + shared_least(n))


def ordered(h: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Hashes that sort rare before heavy shingles; distinct but for chance (one bit is given up)."""
    h2 = h >> np.uint64(1)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
        h2 = h2 | np.where(heavy[at] == h, TOP, np.uint64(0))
    return np.sort(h2)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


class Forest:
    """Signature trees as levels of one array each; level 0 has the sets, the last one the roots.

    tree: the number of each set's tree. Every node holds FAN nodes of the level below at most, and all trees
    are as high as the highest."""

    def __init__(self, tree: np.ndarray, n: np.ndarray, bits: np.ndarray):
        self.order = np.lexsort((bits[:, 0], n, tree))
        tree, n, bits = tree[self.order], n[self.order], bits[self.order]
        self.levels, self.first = [(n, n, bits, n - np.bitwise_count(bits).sum(1))], []
        self.trees = np.unique(tree)
        while len(tree) > len(self.trees):
            lo, hi, b, s = self.levels[-1]
            start = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
            inner = np.arange(len(tree)) - np.repeat(start, np.diff(np.r_[start, len(tree)]))
            at = np.flatnonzero(inner % FAN == 0)
            self.first.append(np.r_[at, len(tree)])
            self.levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.bitwise_or.reduceat(b, at, axis=0), np.maximum.reduceat(s, at)))
            tree = tree[at]


def _possible(x, i, y, j) -> np.ndarray:
    """Whether nodes i of level x and j of level y may hold sets that link."""
    (lo_x, hi_x, b_x, s_x), (lo_y, hi_y, b_y, s_y) = x, y
    size = (4 * hi_x[i] >= 3 * lo_y[j]) & (4 * hi_y[j] >= 3 * lo_x[i])
    i, j = i[size], j[size]
    most = np.empty(len(i), np.int64)
    for k in range(0, len(i), 65_536):
        a, b = i[k : k + 65_536], j[k : k + 65_536]
        most[k : k + 65_536] = np.bitwise_count(b_x[a] & b_y[b]).sum(1) + np.minimum(s_x[a], s_y[b])
    size[size] = 7 * most >= 3 * (lo_x[i] + lo_y[j])
    return size


def _down(forest: Forest, level: int, a: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes below nodes a of a level, each with its node's partner."""
    first = forest.first[level - 1]
    start, many = first[a], first[a + 1] - first[a]
    off = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(start, many) + off, np.repeat(other, many, axis=0)


def traverse(forest: Forest, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, in the forest's own input, of sets of the trees x[k] and y[k] that the bounds leave;
    where both are one tree each pair comes once."""
    root = lambda t: np.minimum(np.searchsorted(forest.trees, t), max(0, len(forest.trees) - 1))
    there = np.isin(x, forest.trees) & np.isin(y, forest.trees)
    x, y = root(x[there]), root(y[there])
    found = [np.empty(0, int)] * 2
    for k in range(0, len(x), 4096):  # trees at once
        i, j = x[k : k + 4096], y[k : k + 4096]
        for level in range(len(forest.levels) - 1, -1, -1):
            ok = _possible(forest.levels[level], i, forest.levels[level], j)
            i, j = i[ok], j[ok]
            if level:
                one = i == j
                i, j = _down(forest, level, i, np.stack([j, one], 1))
                (i, same), j = (i, j[:, 1]), j[:, 0]
                j, both = _down(forest, level, j, np.stack([i, same], 1))
                i, same = both[:, 0], both[:, 1]
                ok = (same == 0) | (i <= j)
                i, j = i[ok], j[ok]
        ok = i != j
        found = [np.r_[found[0], forest.order[i[ok]]], np.r_[found[1], forest.order[j[ok]]]]
    return found[0], found[1]


def sets(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """(id, n, digest, bits, first): size, digest and bitmap of each row's set, and its QUICK least hashes.

    One row of each batch also has the shingles that are common in the batch, and how many rows have them."""
    import pyarrow as pa

    def run(batches):
        import xxhash

        shingles = Shingler()
        for b in parts(batches):
            own = [shingles(t) for t in b.column("t").to_pylist()]
            bits = np.zeros((len(own), BITS), bool)
            for k, s in enumerate(own):
                bits[k, (s % np.uint64(BITS)).astype(np.int64)] = True
            packed = np.packbits(bits, axis=1)
            v, c = np.unique(np.concatenate([*own, np.empty(0, np.uint64)]), return_counts=True)
            many = c > max(1, len(own) // (4 * RARE))
            none = [None] * (len(own) - 1)
            of_batch = lambda x: pa.array([x, *none] if own else [], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([
                b.column("id"), pa.array([len(s) for s in own], pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in own], pa.string()),
                pa.array([r.tobytes() for r in packed], pa.binary()), pa.array([s[:QUICK].view(np.int64) for s in own], pa.list_(pa.int64())),
                of_batch(v[many].view(np.int64)), of_batch(c[many].astype(np.int64)),
            ], ["id", "n", "digest", "bits", "first", "common", "rows"])

    d = docs.select(docs[f"`{doc_id}`"].cast("bigint").alias("id"), docs[f"`{text}`"].alias("t"))
    return d.mapInArrow(freed(run), "id bigint, n bigint, digest string, bits binary, first array<bigint>, common array<bigint>, rows array<bigint>")


def verified(pairs: DataFrame, docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """The rows (a, b) of pairs whose texts link. Texts go to their partner a, which meets them one by one."""
    import pyarrow as pa

    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    many = pairs.groupBy("a").agg(F.count("*").alias("c")).withColumn("parts", F.expr("cast(ceil(c / 1000) as int)"))
    own = many.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    to = lookup(pairs, many.select("a", "parts", "c"), ["a"], "c").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")).unionByName(own)
    d = docs.select(docs[f"`{doc_id}`"].cast("bigint").alias("b"), docs[f"`{text}`"].alias("t"))
    rows = d.join(bounded_broadcast(stored(to, "routes"), 400_000), "b")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("b"), "b")

    def run(batches):
        shingles = Shingler()
        now, held = None, []
        for batch in parts(batches):
            out = []
            for a, b, part, t in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "part", "t")], strict=True):
                if (a, part) != now:
                    now, held = (a, part), []
                if a == b:
                    held.append(shingles(t))
                elif any(links(x, s) for s in [shingles(t)] for x in held):
                    out.append((a, b))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return rows.select("a", "b", "part", "t").mapInArrow(freed(run), "a bigint, b bigint")


def first_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of the first round: each node b with a hub a, where a's and b's trees leave the pair.

    A node's hub is the least node under the most of its QUICK least shingles. A hub's nodes are dealt in
    blocks, each with the hub, so that no hub gathers all of them."""
    import pyarrow as pa

    k = nodes.select("id", F.explode("first").alias("key"))
    lead = k.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("c")).where("c > 1")
    k = lookup(k, lead, ["key"], "c").where("a <> id").groupBy("id", "a").agg(F.count("*").alias("n"))
    hubs = stored(k.groupBy("id").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")), "hubs")
    many = hubs.groupBy("a").agg(F.count("*").alias("c")).withColumn("blocks", F.expr(f"cast(ceil(c / {BLOCK}) as int)"))
    own = many.select("a", F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = lookup(hubs, many.select("a", "blocks", "c"), ["a"], "c").select("a", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    rows = rows.unionByName(own).join(nodes.select("id", "n", "bits"), "id")
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block")

    def run(batches):
        for t in _whole(batches, ("a", "block")):
            a, ids, n, new = t["a"], t["id"], t["n"], t["new"]
            # two trees for each hub and block: the hub's own and that of its nodes
            group = np.cumsum(new) - 1
            forest = Forest(2 * group + (a != ids), n, t["bits"])
            x = 2 * np.arange(int(group[-1]) + 1)
            i, j = traverse(forest, x, x + 1)
            yield pa.RecordBatch.from_pydict({"a": ids[i], "b": ids[j]})

    return rows.select("a", "block", "id", "n", "bits").mapInArrow(freed(run), "a bigint, b bigint")


def _whole(batches, keys: tuple[str, ...]):
    """Columns of sorted rows as arrays, GATHER rows (of many bytes, fewer) or more at once, so that equal keys come together; `new` tells
    where the keys change."""
    import pyarrow as pa

    def columns(rows):
        t = pa.Table.from_batches(rows)
        out = {c: t.column(c).to_numpy() for c in t.column_names if c != "bits"}
        out["bits"] = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(t.num_rows, -1)
        new = np.zeros(t.num_rows, bool)
        for c in keys:
            new |= np.r_[True, out[c][1:] != out[c][:-1]]
        return out | {"new": new}

    held, size, last = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new |= np.r_[True, c[1:] != c[:-1]]
        new[0] = last is not None and last != tuple(c[0] for c in cols)
        last = tuple(c[-1] for c in cols)
        cut = np.flatnonzero(new)
        if size >= GATHER and len(cut) and held:
            yield columns([*held, b.slice(0, int(cut[0]))] if cut[0] else held)
            held, size, b = [], 0, b.slice(int(cut[0]))
        if b.num_rows:
            held.append(b)
            size += b.num_rows + b.nbytes // 1024
    if held:
        yield columns(held)


def heavy_shingles(of_sets: DataFrame, most: int = MOST_HEAVY) -> np.ndarray:
    """Shingles of more than HEAVY rows by the batches' counts, the `most` heaviest ones.

    They decide the order of shingles alone, for which an estimate does: any order is right."""
    c = of_sets.where("common is not null").select(F.explode(F.arrays_zip("common", "rows")).alias("x"))
    c = c.groupBy(F.col("x.common").alias("key")).agg(F.sum("x.rows").alias("c")).where(F.col("c") > HEAVY).orderBy(F.desc("c"), "key").limit(most)
    return np.sort(np.array([r[0] for r in c.select("key").collect()], np.int64).view(np.uint64))


def shared_prefixes(d: DataFrame, heavy: np.ndarray, buckets: int) -> DataFrame:
    """Rows (key, id, comp) of shingles that prefixes of different components share; id is -1 for heavy keys."""
    import pyarrow as pa

    sent = d.sparkSession.sparkContext.broadcast(heavy)
    shift = np.uint64(max(1, buckets))
    kind = np.dtype([("k", "<u8"), ("id", "<i8"), ("comp", "<i8")])

    def pack(batches):
        shingles = Shingler()

        def single(e):
            """Of the frequent shingles' entries, which have no id, one for each component."""
            h = e[e["id"] < 0]
            h = h[np.lexsort((h["comp"], h["k"]))]
            first = np.r_[True, (h["k"][1:] != h["k"][:-1]) | (h["comp"][1:] != h["comp"][:-1])][: len(h)]
            return np.concatenate([e[e["id"] >= 0], h[first]])

        def runs():
            own, size = [], 0
            for b in parts(batches):
                for i, c, t in zip(*[b.column(x).to_pylist() for x in ("id", "comp", "t")], strict=True):
                    h = ordered(shingles(t), sent.value)
                    h = h[: prefix(len(h))] if len(h) else h
                    e = np.empty(len(h), kind)
                    e["k"], e["id"], e["comp"] = h, np.where(h >= TOP, -1, i), c
                    own.append(e)
                    size += len(e)
                if size >= RUN:
                    yield single(np.concatenate(own))
                    own, size = [], 0
            if own:
                yield single(np.concatenate(own))

        for e in runs():
            to = (e["k"] % shift).astype(np.uint32)
            at = np.argsort(to, kind="stable")
            e, to = e[at], to[at]
            cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(e) else []
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(to[c]) for c in cut], pa.int32()), "blob": pa.array([x.tobytes() for x in np.split(e, cut[1:])] if len(e) else [], pa.binary())})

    def meet(batches):
        blobs = [x for b in batches for x in b.column("blob").to_pylist()]
        if not blobs:
            return
        e = np.concatenate([np.frombuffer(x, kind) for x in blobs])
        del blobs
        e = e[np.argsort(e["k"], kind="stable")]
        cut = np.flatnonzero(np.r_[True, e["k"][1:] != e["k"][:-1]])
        mixed = np.minimum.reduceat(e["comp"], cut) != np.maximum.reduceat(e["comp"], cut)
        e = e[np.repeat(mixed, np.diff(np.r_[cut, len(e)]))]
        for k in range(0, len(e), 50_000):
            p = e[k : k + 50_000]
            yield pa.RecordBatch.from_pydict({"key": p["k"].view(np.int64), "id": np.ascontiguousarray(p["id"]), "comp": np.ascontiguousarray(p["comp"])})

    return d.select("id", "comp", "t").mapInArrow(freed(pack), "bucket int, blob binary").repartition(buckets, "bucket").select("blob").mapInArrow(freed(meet), "key bigint, id bigint, comp bigint")


def heavy_members(d: DataFrame, heavy: np.ndarray, keys: np.ndarray) -> DataFrame:
    """Rows (key, id, comp) of all documents that have one of these heavy keys in their prefix."""
    import pyarrow as pa

    sent = d.sparkSession.sparkContext.broadcast((heavy, np.sort(keys)))

    def run(batches):
        shingles = Shingler()
        heavy, keys = sent.value
        for b in parts(batches):
            out = []
            for i, c, t in zip(*[b.column(x).to_pylist() for x in ("id", "comp", "t")], strict=True):
                h = ordered(shingles(t), heavy)
                out += [(int(k), i, c) for k in np.intersect1d(h[: prefix(len(h))], keys).view(np.int64)] if len(h) else []
            yield pa.RecordBatch.from_pydict({n: pa.array([x[k] for x in out], pa.int64()) for k, n in enumerate(("key", "id", "comp"))})

    return d.select("id", "comp", "t").mapInArrow(freed(run), "key bigint, id bigint, comp bigint")


def whole_sets(d: DataFrame) -> DataFrame:
    """(id, own): the whole set of each text of d (id, t), as sorted 64-bit hashes."""
    import pyarrow as pa

    def run(batches):
        shingles = Shingler()
        for b in parts(batches):
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "own": pa.array([shingles(t).tobytes() for t in b.column("t").to_pylist()], pa.binary())})

    return d.select("id", "t").mapInArrow(freed(run), "id bigint, own binary")


def ties(a: np.ndarray, b: np.ndarray, comp: np.ndarray, own: list[np.ndarray]):
    """Which of the pairs of sets own[a], own[b] link and tie components that those before have not tied: fewer than
    there are sets, however many pairs. Wide bitmaps drop most pairs that don't link; what they leave is compared exactly."""
    n = np.array([len(s) for s in own], np.int64)
    bits = np.zeros((len(own), WIDE // 64), np.uint64)
    for k in np.unique(np.r_[a, b]):
        has = np.zeros(WIDE, bool)
        has[(own[k] % np.uint64(WIDE)).astype(np.int64)] = True
        bits[k] = np.packbits(has).view(np.uint64)
    spare = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    for k in range(0, len(a), 2048):
        x, y = a[k : k + 2048], b[k : k + 2048]
        most = np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64) + np.minimum(spare[x], spare[y])
        for j in np.flatnonzero(7 * most >= 3 * (n[x] + n[y])).tolist():
            c, e = top(int(comp[x[j]])), top(int(comp[y[j]]))
            if c != e and links(own[x[j]], own[y[j]]):
                root[max(c, e)] = min(c, e)
                yield k + j


def tree_links(members: DataFrame, d: DataFrame) -> DataFrame:
    """Links (a, b) that tie different components, among the pairs that trees over the members (key, lead, id, comp, n,
    bits) of each key leave; d (id, t) has their texts.

    Keys are dealt by their lead, the least id under them: the shingles of a passage have the same members,
    so a pair that shares a passage is mostly met in one place. A lead with many rows is cut by blocks of
    ids (all keys of a pair stay together) and, beyond PART rows, by keys, so that no place has many more. A place
    also has the whole set of each of its documents, once, and compares pairs itself: of links that tie components
    it sends fewer than it has documents, where its pairs may be as many as the square of that."""
    import pyarrow as pa

    by_lead = members.groupBy("lead", "key").agg(F.count("*").alias("c")).groupBy("lead").agg(F.max("c").alias("most"), F.sum("c").alias("c"))
    by_lead = by_lead.withColumn("blocks", F.expr(f"cast(ceil(most / {BLOCK}) as int)")).withColumn("parts", F.expr(f"cast(ceil(2 * c / blocks / {PART}) as int)"))
    m = lookup(members, by_lead.where("blocks > 1 or parts > 1").select("lead", "blocks", "parts", "c"), ["lead"], "c")
    m = m.withColumns({"blocks": F.coalesce("blocks", F.lit(1)), "part": F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1)))})
    m = m.withColumn("of", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    m = m.select("lead", "part", "key", "id", "comp", "n", "bits", "of", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    m = m.withColumns({"i": F.least("of", "other"), "j": F.greatest("of", "other")})
    m = m.select(F.xxhash64("lead", "part", "i", "j").alias("place"), "key", "i", "j", "of", "id", "comp", "n", "bits", F.lit(None).cast("binary").alias("own"))
    ids = stored(members.select("id").distinct(), "ids")
    sets_of = stored(whole_sets(d.join(bounded_broadcast(ids, 400_000), "id", "left_semi")), "whole_sets")
    # rows of sets stand under no block
    zero = F.lit(0)
    s = m.select("place", "id").distinct().join(sets_of, "id")
    s = s.select("place", zero.cast("long").alias("key"), zero.alias("i"), zero.alias("j"), F.lit(-1).alias("of"), "id", zero.cast("long").alias("comp"), zero.cast("long").alias("n"), F.lit(bytes(BITS // 8)).alias("bits"), "own")
    m = m.unionByName(s).repartition("place").sortWithinPartitions("place", "key", "of", "id")

    def run(batches):
        for t in _whole(batches, ("place",)):
            at, held = np.flatnonzero(t["of"] >= 0), np.flatnonzero(t["of"] < 0)
            place = np.cumsum(t["new"]) - 1
            ids, n, comp, key, of, of_place = *(t[c][at] for c in ("id", "n", "comp", "key", "of")), place[at]
            # a tree for each group, or one for each of a group's two blocks, which meet each other
            new = np.r_[True, (of_place[1:] != of_place[:-1]) | (key[1:] != key[:-1])]
            second = np.r_[False, of[1:] != of[:-1]] & ~new
            tree = np.cumsum(new | second) - 1
            x = tree[np.flatnonzero(new)]
            y = np.r_[x[1:], int(tree[-1]) + 1] - 1
            alone = (t["i"] != t["j"])[at][new] & (x == y)  # of two blocks only one has members
            a, b = traverse(Forest(tree, n, t["bits"][at]), x[~alone], y[~alone])
            ok = comp[a] != comp[b]
            a, b = a[ok], b[ok]
            # members as the sets of their place: those are in order of place and id
            names = np.rec.fromarrays([place[held], t["id"][held]])
            spot = np.searchsorted(names, np.rec.fromarrays([of_place, ids]))
            comp_of = np.zeros(len(held), np.int64)
            comp_of[spot] = comp
            p = np.unique(np.stack([np.minimum(spot[a], spot[b]), np.maximum(spot[a], spot[b])], 1), axis=0)
            ends, out = np.flatnonzero(np.diff(names["f0"], append=-1)) + 1, []
            for lo, hi in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                q = p[np.searchsorted(p[:, 0], lo) : np.searchsorted(p[:, 0], hi)]
                if len(q):
                    own = [np.frombuffer(v, np.uint64) for v in t["own"][held[lo:hi]]]
                    out += q[list(ties(q[:, 0] - lo, q[:, 1] - lo, comp_of[lo:hi], own))].tolist()
            o = t["id"][held][np.array(out, np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_pydict({"a": pa.array(o[:, 0]), "b": pa.array(o[:, 1])})

    return m.mapInArrow(freed(run), "a bigint, b bigint").distinct()


def may_link(members: DataFrame, rounds: int = 2) -> DataFrame:
    """The members (key, id, comp, n) that can be in a pair that links, each with its key's least id as lead.

    A partner has 0.75 of a document's size at least, so the document needs as many shared shingles as that
    size asks for. Those with fewer go, then shingles that are left with one component; what goes can't
    link, so this may be done again. The work follows the members, not their pairs."""
    need = 1 + F.floor(F.ceil(F.col("n") * 3 / 4) / 10)
    for _ in range(rounds):
        keep = stored(members.groupBy("id").agg(F.count("*").alias("c"), F.max("n").alias("n")).where(F.col("c") >= need).select("id"), "keep")
        members = members.join(bounded_broadcast(keep, 400_000), "id", "left_semi")
        mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("id").alias("lead"), F.count("*").alias("c")).where("lo <> hi").select("key", "lead", "c")
        members = stored(lookup(members.drop("lead"), mixed, ["key"], "c").where("lead is not null"), "members")
    return members


def classes(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """(id, n, component) for each row of docs; different texts under one id are linked each by its own."""
    d = docs.select(docs[f"`{doc_id}`"].cast("bigint").alias("id"), docs[f"`{text}`"].alias("t"))
    keys = text_keys(d)
    if keys is None:
        return _classes(docs, doc_id, text)
    out = stored(_classes(_by_key(d, keys), "key", "t"), "by_key")
    own = keys.select(F.col("key").alias("id"), F.col("id").alias("own"), "c")
    out = lookup(out, own, ["id"], "c")
    met = out.groupBy("component").agg(F.count("*").alias("c")).where("component is not null")
    met = met.join(own.select(F.col("id").alias("component"), F.col("own").alias("least")), "component")
    out = lookup(out, met, ["component"], "c")
    return out.select(F.col("own").alias("id"), "n", F.col("least").alias("component"))


def _by_key(d: DataFrame, keys: DataFrame) -> DataFrame:
    """d (id, t, ...) stored with the key of each row's id and text."""
    return stored(lookup(d.withColumn("th", text_hash(F.col("t"))), keys, ["id", "th"], "c").drop("th"), "keyed")


def _classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """classes() where each id has one text."""
    spark = docs.sparkSession
    all_sets = stored(sets(docs, doc_id, text), "sets")
    known = all_sets.where("n > 0 and id is not null")
    same = known.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("c"))
    nodes = stored(known.join(same.select(F.col("node").alias("id"), "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]), "nodes")
    first = stored(verified(first_pairs(nodes), docs, doc_id, text), "first_links")
    comp = components(first)
    tokens = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(tokens // 8_000_000 + 1, MOST_BUCKETS))

    d = docs.select(docs[f"`{doc_id}`"].cast("bigint").alias("id"), docs[f"`{text}`"].alias("t"))
    d = d.join(bounded_broadcast(nodes.select("id"), 1_000_000), "id", "left_semi").join(bounded_broadcast(comp, 400_000), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), "t")
    heavy = heavy_shingles(all_sets, MOST_HEAVY)
    groups = stored(shared_prefixes(d, heavy, buckets), "groups")
    keys = groups.where("id < 0").select("key").distinct()
    hot = np.array([r[0] for r in keys.collect()], np.int64).view(np.uint64)  # some of the heavy ones
    members = groups.where("id >= 0")
    if len(hot):
        members = members.unionByName(heavy_members(d, heavy, hot))
    members = may_link(stored(members.join(nodes.groupBy("id").agg(F.min("n").alias("n")), "id"), "shared"))
    members = members.drop("n").join(nodes.select("id", "n", "bits"), "id")
    two = stored(tree_links(stored(members, "members"), d), "second_links")
    comp = components(first.unionByName(two))

    out = all_sets.select("id", "n", "digest")
    out = lookup(out, same, ["digest"], "c", 300_000)
    out = out.join(bounded_broadcast(comp.select(F.col("id").alias("node"), "comp"), 400_000), "node", "left")
    return out.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("comp", "node")).otherwise(F.col("id")).alias("component"))


def keep_one(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """docs with one document of each component: the one with the least id, of different texts under it
    the one with the least hash. Rows with a null id stay; rows that share id and text are one document, so that
    they stay or go together."""
    d = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{doc_id}`"].cast("bigint").alias("id"))
    keys = text_keys(docs.select(docs[f"`{doc_id}`"].cast("bigint").alias("id"), docs[f"`{text}`"].alias("t")))
    if keys is not None:
        d = _by_key(d.withColumn("t", F.col("row")[text]), keys)
        links = _classes(d, "key", "t")
        d = d.select("row", F.col("key").alias("id"))
    else:
        links = _classes(docs, doc_id, text)
    drop = stored(links.where("component <> id").select("id").distinct(), "drop")
    return d.join(bounded_broadcast(drop, 500_000), "id", "left_anti").select("row.*")


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


SHINGLES_SQL = r"""
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from src),
s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as x from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
link as (select a, b from common join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
edge as (select a, b from link union all select b, a from link union all select doc_id, doc_id from src),
reach as (select a as doc_id, b as to_id from edge union select reach.doc_id, edge.b from reach join edge on edge.a = reach.to_id),
comp as (select doc_id, min(to_id) as component_id from reach group by doc_id)"""

SQL = f"""with recursive src as (select * from documents), {SHINGLES_SQL}
select comp.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, component_id from comp left join n using (doc_id)"""
