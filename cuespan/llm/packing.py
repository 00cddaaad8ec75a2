"""Cost-balanced packing of documents into training sequences of a fixed length.

A document's ids (and the id that ends it) are cut into pieces of CONTEXT ids, each a sequence of its own, and
a rest. Rests wait in a group of GROUP sequences; a full group is packed: the rests, longest first, go each to
the sequence of the lowest cost so far that still has room for all of it. A rest for which no sequence has room
is cut: it fills the lowest-cost sequences that have any. A piece of n ids costs LINEAR * n + QUADRATIC * n * n, the
work of the feed-forward layers and of attention within a document. A group's sequences are filled to the
last place; what is over, under CONTEXT ids, waits for the next group. At the end of a task it becomes sequences
of powers of two, which need no padding, so nothing is padded at all.

Packing happens where a text is read, in one pass and without a shuffle; a task holds a group and one
document. Groups are of one task: its sequences are balanced among one another. A sequence's number is the
task's partition and a count, so a task that runs again gives the same ones.

Ids come from the tokenizers library. Its rule for this vocabulary parts words at white space, so a text's ids are those of
its words; a worker keeps a bounded table of the words that it has met, and asks the library for new ones.

Defined cases: null is as empty, which has the end's id alone; repeated rows are packed apart; columns of
any names may stand beside; an empty table gives an empty result; of a very long text, words are taken in
blocks and a run without white space is encoded by the tree of bpe.py.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import Codec
from .common import local_file, parts, table

#: Ids of a sequence, the id that ends a document, sequences of a group, and the two weights of a piece's cost.
CONTEXT, END, GROUP = 2048, 1, 256
LINEAR, QUADRATIC = 1.0, 1 / 2048
#: Words that a worker's table holds, the longest one that it keeps, and characters that are split at once.
WORDS, LONGEST, BLOCK = 2_000_000, 64, 1 << 18
#: White space to Python's split() but not to the vocabulary's rule.
ODD = re.compile("[\x1c-\x1f]")
SPLIT = re.compile("[ \t\n\r]+")
#: A word of letters that lower-case one by one, and at most one mark, which is always a token of its own.
PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,;:!?]?)")


def _raw(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Words:
    """The ids of texts as bytes (little-endian, 32 bits each), by a table of their words."""

    def __init__(self, path: str, most: int | None = None):
        import json

        from tokenizers import Tokenizer

        self.codec = Codec(path)
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.letters = Tokenizer.from_str(json.dumps(self.codec.spec | {"pre_tokenizer": level}))  # words of letters alone need no rule
        self.table: dict[str, bytes] = {}
        self.most = most

    def _learn(self, words: set[str]) -> None:
        plain, others = {}, []
        for w in words:
            if m := PLAIN.fullmatch(w.lower()):
                plain[w] = m.groups()
            else:
                others.append(w)
        cores = [*{c for c, _ in plain.values() if c not in self.table}]
        marks = [*{m for _, m in plain.values()}]
        self.table.update((c, _raw(e.ids)) for c, e in zip(cores, self.letters.encode_batch_fast(cores, add_special_tokens=False), strict=True))
        ends = {m: _raw(i) for m, i in zip(marks, self.codec.ids(marks), strict=True)}
        known = self.table
        known.update([(w, known[c] + ends[m]) for w, (c, m) in plain.items()])
        self.table.update((w, _raw(i)) for w, i in zip(others, self.codec.ids(others), strict=True))

    def _blocks(self, texts: list[str]) -> list[bytes]:
        lists = [SPLIT.split(t) if ODD.search(t) else t.split() for t in texts]
        got = [[*map(self.table.get, x)] for x in lists]
        if new := {w for x, g in zip(lists, got, strict=True) if None in g for w, v in zip(x, g, strict=True) if v is None}:
            own = {}
            if long := {w for w in new if len(w) > LONGEST}:  # these are never kept
                own = {w: _raw(i) for w, i in zip(long, self.codec.encode([*long]), strict=True)}
            if len(self.table) + 2 * len(new) > (self.most or WORDS):
                self.table.clear()
            self._learn(new - long)
            own |= {w: self.table[w] for w in new - long}
            got = [[own[w] if v is None else v for w, v in zip(x, g, strict=True)] for x, g in zip(lists, got, strict=True)]
        return [b"".join(g) for g in got]

    def ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            at, cuts = 0, [0]
            while len(t) - at > BLOCK:
                m = SPLIT.search(t, at + BLOCK)
                at = m.start() if m else len(t)
                cuts.append(at)
            out.append([*cuts, len(t)])
        if all(len(c) == 2 for c in out):
            return self._blocks(texts)
        return [b"".join(self._blocks([t[a:b]])[0] for a, b in zip(c, c[1:])) for t, c in zip(texts, out, strict=True)]


@lru_cache(1)
def words_of(path: str, most: int | None = None) -> Words:
    """A worker's table lives on from task to task; it is bounded."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(path, most)


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


class Group:
    """Rests that wait for their sequences: (document, start, end) with the documents' numbers."""

    def __init__(self, first: int):
        self.rests: list[tuple[int, int, int]] = []
        self.size, self.next = 0, first

    def add(self, doc: int, start: int, end: int) -> None:
        self.rests.append((doc, start, end))
        self.size += end - start

    def pack(self, room: list[int]):
        """Yields (document, start, end, sequence, offset) for new sequences of those sizes; what is over stays."""
        size = np.array(room, np.int64)
        left, spent = size.copy(), np.zeros(len(room))
        waiting = sorted(self.rests, key=lambda r: (r[1] - r[2], r))
        self.rests, self.size = [], 0
        for doc, a, b in waiting:
            while a < b:
                fit = np.where(left >= b - a, spent, np.inf)
                k = int(fit.argmin())
                if fit[k] == np.inf:  # none has room for all of it
                    fit = np.where(left > 0, spent, np.inf)
                    k = int(fit.argmin())
                    if fit[k] == np.inf:
                        self.add(doc, a, b)
                        break
                n = min(b - a, int(left[k]))
                yield doc, a, a + n, self.next + k, int(size[k] - left[k])
                left[k] -= n
                spent[k] += cost(n)
                a += n
        self.next += len(room)


def pack(docs: DataFrame, path: str, doc_id="doc_id", text="text") -> DataFrame:
    """The pieces of docs: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    import pyarrow as pa

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        words, end = words_of(path), _raw([END])
        group = Group(TaskContext.get().partitionId() << 33)
        held: dict[int, tuple] = {}  # documents with rests that wait
        rows, arrow, n = [], None, 0

        def row(doc, a, b, seq, at):
            who, ids, total, base = held[doc]
            rows.append((who, a, b - a, zlib.crc32(ids[(a - base) * 4 : (b - base) * 4]), total, seq, at))

        def flush(room):
            for p in group.pack(room):
                row(*p)
            for k in held.keys() - {r[0] for r in group.rests}:
                del held[k]

        def out():
            cols = [*zip(*rows, strict=True)] or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], arrow), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        for b in parts(batches, 32, 96 << 10):
            arrow = b.column("doc_id").type
            texts = [t or "" for t in b.column("t").to_pylist()]
            for who, own in zip(b.column("doc_id").to_pylist(), words.ids(texts), strict=True):
                ids = memoryview(own + end)
                total = len(ids) // 4
                whole = total - total % CONTEXT
                held[n] = (who, ids, total, 0)
                for a in range(0, whole, CONTEXT):
                    row(n, a, a + CONTEXT, group.next, 0)
                    group.next += 1
                if whole < total:
                    held[n] = (who, memoryview(bytes(ids[whole * 4 :])), total, whole)
                    group.add(n, whole, total)
                else:
                    del held[n]
                n += 1
                if group.size >= GROUP * CONTEXT:
                    flush([CONTEXT] * (group.size // CONTEXT))
                if len(rows) >= 4096:
                    yield out()
        if group.size:
            rest = group.size % CONTEXT
            flush([CONTEXT] * (group.size // CONTEXT) + [1 << k for k in range(CONTEXT.bit_length() - 1, -1, -1) if rest >> k & 1])
        if rows:
            yield out()

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("t")).mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, used, padding, cost) of pack()'s pieces."""
    from pyspark.sql import functions as F

    d = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.sum(cost(F.col("length"))).alias("cost"))
    power = F.expr("bit_count(used) = 1")
    return d.select("sequence_id", "used", F.when(power, 0).otherwise(CONTEXT - F.col("used")).alias("padding"), "cost")


def op11_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), local_file("word_bpe_49k.json"))
