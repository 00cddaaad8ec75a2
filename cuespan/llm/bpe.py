"""BPE encoding and decoding by tree concatenation.

A text is halved, at any place, until its leaves have LEAF characters at most. The leaves of all texts that a
task holds are encoded as one batch; then neighbours are joined level by level up to the whole text. At a
join a window around the cut is encoded anew: it opens and closes at white space, where this vocabulary's rule
always parts words, so that tokens on its two sides don't depend on each other. Both sides agree if the left
one ends, and the right one begins, with the encoding of its own part of the window; else the window grows, at
last over both sides, where it is the encoding itself. The windows' tokens then replace those parts'.

Leaves get the library's ids by a worker's bounded table of words (packing.py), as their words part at white space too.

A run without white space that is longer than RUN is a tree of its own: its words' leaves are joined where a
window's encoding shares a token with the left side and one with the right. A sequence of tokens is the
encoding of its text exactly if every neighbouring pair is the encoding of its own text; each pair of the
joined sequence stands in one of the three agreed encodings, so the join is exact.

Decoding goes from ids to the vocabulary's strings. The table of documents is dealt as it is scanned and
nothing is shuffled; a task holds a few megabytes of texts at once. Defined cases: null is as empty (no
tokens); repeated rows give the same row each; columns of any names may stand beside; an empty table gives an
empty result; special tokens in a text are read as those tokens.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import freed, local_file, parts, table

#: Characters of a leaf, of an unsplit run that is a tree of its own, and of that tree's leaves and first windows.
LEAF, RUN, WORD_LEAF, WINDOW = 2048, 256, 256, 16
#: Words that a worker's table holds; other stages' workers need memory beside it.
TABLE = 1_000_000
SPACES = " \n\t\r"


class Codec:
    """Texts to ids and back; `joins` counts the joins of halves."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.load(open(path))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.plain = spec.get("decoder") is None  # then a text is its tokens, joined by one space
        names = {**{i: s for s, i in self.whole.get_vocab(with_added_tokens=True).items()}}
        self.strings = [names.get(i, "") for i in range(max(names) + 1)]
        self.numbers = [str(i) for i in range(len(self.strings))]
        self.spec = spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": [], "post_processor": None}
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.long = re.compile(f"[^{SPACES}]{{{RUN + 1},}}")
        self.joins = 0
        self.leaves = self.ids  # what encodes leaves

    @cached_property
    def word(self):
        """The merges alone, on the byte alphabet; only long runs need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(json.dumps(self.spec))

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids)) if self.plain else self.whole.decode(ids, skip_special_tokens=False)

    def encode(self, texts: list[str], leaf: int = LEAF) -> list[list[int]]:
        """The ids of each text."""
        jobs, leaves = [], []
        for k, t in enumerate(texts):
            at = 0
            # most texts have no such run, which their words tell sooner than the pattern
            for m in self.long.finditer(t) if max(map(len, t.split()), default=0) > RUN else ():
                jobs += [(k, t[at : m.start()]), (k, m[0])]
                at = m.end()
            jobs.append((k, t[at:]))
        spans = []
        for k, t in jobs:  # halves, down to leaves
            own = [(0, len(t))]
            while own[0][1] - own[0][0] > leaf and len(t) > leaf and not self._run(t):
                own = [h for a, b in own for h in ((a, (a + b) // 2), ((a + b) // 2, b))]
            spans.append(own)
            leaves += [t[a:b] for a, b in own] if not self._run(t) else []
        done = iter(self.leaves(leaves))
        out: list[list[int]] = [[] for _ in texts]
        for (k, t), own in zip(jobs, spans, strict=True):
            if self._run(t):
                out[k] += self.run(t)
                continue
            level = [(a, b, next(done)) for a, b in own]
            while len(level) > 1:
                level = [self.join(t, *level[i], *level[i + 1][1:]) for i in range(0, len(level), 2)]
            out[k] += level[0][2]
        return out

    def _run(self, t: str) -> bool:
        return len(t) > RUN and not any(c in t for c in SPACES)

    def join(self, t: str, a: int, cut: int, left: list[int], b: int, right: list[int]) -> tuple[int, int, list[int]]:
        """The encoding of t[a:b] from those of t[a:cut] and t[cut:b]."""
        self.joins += 1
        lo = hi = cut
        while True:
            lo = max([a, *(t.rfind(c, a, max(a, lo)) for c in SPACES)])
            hi = min([b, *(x for c in SPACES if (x := t.find(c, min(b, hi + (hi > cut)), b)) >= 0)])
            head, window, tail = self.ids([t[lo:cut], t[lo:hi], t[cut:hi]])
            if left[len(left) - len(head) :] == head and right[: len(tail)] == tail:
                return a, b, left[: len(left) - len(head)] + window + right[len(tail) :]

    def run(self, text: str) -> list[int]:
        """The ids of a text without white space."""
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                own = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                for word, _ in self.whole.pre_tokenizer.pre_tokenize_str(own):
                    out += [i for i, _ in self.tree(word)]
        return out

    def tree(self, word: str, leaf: int = WORD_LEAF) -> list[tuple[int, str]]:
        """The tokens (id, string) of one word in the byte alphabet."""
        if len(word) <= leaf:
            return self._batch([word])[0]
        cuts = [*range(0, len(word), leaf)]
        spans = [(a, min(a + leaf, len(word))) for a in cuts]
        level = list(zip(spans, self._batch([word[a:b] for a, b in spans]), strict=True))
        while len(level) > 1:
            self.joins += len(level) // 2
            pairs = [self._join(word, *level[i], *level[i + 1]) for i in range(0, len(level) - 1, 2)]
            level = pairs + level[len(pairs) * 2 :]
        return level[0][1]

    def _batch(self, words: list[str]) -> list[list[tuple[int, str]]]:
        return [list(zip(e.ids, e.tokens, strict=True)) for e in self.word.encode_batch(words, add_special_tokens=False)]

    def _ends(self, tokens: list[tuple[int, str]], at: int) -> list[int]:
        """Where each token ends; the mark of a word's end takes no place."""
        out = []
        for _, s in tokens:
            at += len(s) - (len(self.end) if self.end and s.endswith(self.end) else 0)
            out.append(at)
        return out

    def _join(self, word, span_l, left, span_r, right):
        (a, cut), (_, b) = span_l, span_r
        ends_l, ends_r = self._ends(left, a), self._ends(right, cut)
        starts_r = [cut, *ends_r[:-1]]
        size = WINDOW
        while True:
            # the window opens and closes where a token of either side does
            i = max((k for k, e in enumerate(ends_l) if e <= cut - size), default=-1)
            j = min((k for k, s in enumerate(starts_r) if s >= cut + size), default=len(right))
            lo, hi = (ends_l[i] if i >= 0 else a), (starts_r[j] if j < len(right) else b)
            mid = self._batch([word[lo:hi]])[0]
            ends_m = self._ends(mid, lo)
            starts_m = [lo, *ends_m[:-1]]
            own_l = {(s, e): k for k, (s, e) in enumerate(zip([a, *ends_l[:-1]], ends_l, strict=True))}
            own_r = {(s, e): k for k, (s, e) in enumerate(zip(starts_r, ends_r, strict=True))}
            first = next(((k, own_l[s, e]) for k, (s, e) in enumerate(zip(starts_m, ends_m, strict=True)) if (s, e) in own_l and left[own_l[s, e]] == mid[k]), None) if lo > a else (-1, -1)
            last = next(((k, own_r[s, e]) for k, (s, e) in reversed([*enumerate(zip(starts_m, ends_m, strict=True))]) if (s, e) in own_r and right[own_r[s, e]] == mid[k]), None) if hi < b else (len(mid) - 1, len(right) - 1)
            if first and last and first[0] < last[0]:
                return (a, b), left[: first[1] + 1] + mid[first[0] + 1 : last[0] + 1] + right[last[1] + 1 :]
            size *= 2


@lru_cache(2)
def codec(path: str) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory of their own
    return Codec(path)


def encode(docs: DataFrame, path: str, doc_id="doc_id", text="text", with_ids=False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and with with_ids the ids themselves."""
    import pyarrow as pa

    def run(batches):
        from .packing import words_of

        c, words = codec(path), words_of(path, TABLE)
        c.leaves = lambda texts: [np.frombuffer(x, "<u4").tolist() for x in words.ids(texts)]
        for b in parts(batches, 32, 96 << 10):
            done = c.encode([t or "" for t in b.column("t").to_pylist()])
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            cols = [b.column("doc_id"), pa.array([len(e) for e in done], pa.int64())]
            cols += [pa.array([sha(" ".join(map(c.numbers.__getitem__, e))) for e in done], pa.string()), pa.array([sha(c.decode(e)) for e in done], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array([np.array(e, np.int32) for e in done], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
        codec.cache_clear()  # the worker lives on, for other stages

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("t")).mapInArrow(freed(run), schema)


def decode(encoded: DataFrame, path: str, ids="ids") -> DataFrame:
    """encoded with a column `decoded`: the text that the vocabulary's decoder gives for the ids."""
    import pyarrow as pa

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [None if x is None else c.decode(x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(freed(run), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), local_file("word_bpe_49k.json"))
