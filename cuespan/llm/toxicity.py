"""Toxic spans by a linear-chain conditional random field.

Chains are sentences, of any length, so a document of any length is many chains and none of it is left out. Tokens are labelled from document labels: a word is offensive if it
stands in toxic training documents far more often than in others. Two labels, so each feature has one
weight (toxic over clean): the word, its first letters, its ending and its shape, and the words beside it. Forward and
backward messages are ratios, carried for all chains of a batch at once. The expected number of toxic
tokens, that number for each token and the largest marginal give a document's score by a logistic function;
tokens with a marginal of 0.5 or more give the offending offsets.

Learning takes a bounded sample, SAMPLE documents of label 0 and 1 at most, of at most SAMPLE_CHARS
characters; scoring takes every document whole. The weights are a fixed-size array that goes to the
tasks. Defined cases: null and empty texts have no token and score by the logistic function's
constant; without both labels in the training rows every score is 0; repeated rows score alike; ids with
both labels teach nothing, of different texts under a labelled id the least one in order does; ties of the
sample's hash order go by id; columns of any names may stand beside; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, table

SAMPLE, SAMPLE_CHARS, DIMS, SURE = (3_000, 1_200), 20_000, 1 << 16, 20.0
#: Different tokens whose features a worker keeps.
KNOWN = 200_000
#: Lengths of the first letters that count as a word's stem; how many features tell of the token itself.
STEMS, OWN = (5, 7), 5
STRIP = ".,;:!?\"'()[]{}<>*#$%&|-_`~"


#: The hash of each feature's kind, from which that of its text goes on.
KIND = {k: zlib.crc32(k.encode()) for k in ("w", "e", "s", "p", "n", *map(str, STEMS))}


def _shape(token: str) -> str:
    """Letters as A and a, what comes several times in a row once; of that the first places."""
    if token.isalpha():  # most tokens
        if token.islower():
            return "a"
        if token[0].isupper() and token[1:].islower():
            return "Aa"
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", token))[:8]


def _features(token: str) -> tuple[int, int, int, int, int, int, int, bool]:
    """Hashed features of a token: OWN of its word, ending, shape and first letters; the word as its neighbours see
    it (before, after); sentence end."""
    w = token.lower().strip(STRIP)
    b, crc, kind, top = w.encode(), zlib.crc32, KIND, DIMS - 1
    plain = len(b) == len(w)
    end = b[-3:] if plain else w[-3:].encode()
    stems = [crc(b[:n] if plain else w[:n].encode(), kind[str(n)]) & top for n in STEMS]
    return crc(b, kind["w"]) & top, crc(end, kind["e"]) & top, crc(_shape(token).encode(), kind["s"]) & top, *stems, crc(b, kind["p"]) & top, crc(b, kind["n"]) & top, token[-1] in ".!?"


class _Known:
    """A bounded table of tokens' features."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.rows = np.empty((0, OWN + 3), np.int32)

    def __call__(self, tokens: list[str]) -> np.ndarray:
        new = list(set(tokens).difference(self.places))
        rows = self.rows
        if new:
            self.places.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
            rows = np.concatenate([rows, np.array([_features(t) for t in new], np.int32)])
        out = rows[np.fromiter(map(self.places.__getitem__, tokens), np.int64, len(tokens))]
        if len(rows) > KNOWN:  # full: the frequent tokens came early and stay
            for t in new:
                del self.places[t]
        else:
            self.rows = rows
        return out


_known = _Known()


def _chains(texts: list[str]):
    """Features of all tokens of the texts, the document of each, and the chains' starts and lengths."""
    tokens, ends, sizes = [], [], []
    for t in texts:
        before = len(tokens)
        for line in t.split("\n"):
            own = line.split()
            if own:
                tokens += own
                ends.append(len(tokens))
        sizes.append(len(tokens) - before)
    if not tokens:
        return None
    a = _known(tokens)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    stop = a[:, OWN + 2].astype(bool)
    stop[np.array(ends) - 1] = True
    start = np.flatnonzero(np.r_[True, stop[:-1]])
    length = np.diff(np.r_[start, len(a)])
    first = np.zeros(len(a), bool)
    first[start] = True
    return a, owner, start, length, first


def _emit(a: np.ndarray, first: np.ndarray, w: np.ndarray) -> np.ndarray:
    e = w[a[:, :OWN]].sum(1)
    last = np.r_[first[1:], True]
    e[1:] += np.where(first[1:], 0, w[a[:-1, OWN]])
    e[:-1] += np.where(last[:-1], 0, w[a[1:, OWN + 1]])
    return np.clip(e, -30, 30)


def messages(x: np.ndarray, start: np.ndarray, length: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages as ratios of label 1 to label 0; x: emissions, t: transitions, as factors."""
    order = np.argsort(-length, kind="stable")
    s, n = start[order], length[order]
    fwd, bwd = np.empty_like(x), np.ones_like(x)
    live = np.searchsorted(-n, -np.arange(int(n[0])), side="left")  # chains that reach each place
    fwd[s] = x[s]
    for k in range(1, len(live)):
        i = s[: live[k]] + k
        r = fwd[i - 1]
        fwd[i] = x[i] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
    for k in range(len(live) - 1, 0, -1):
        i = s[: live[k]] + k
        b = x[i] * bwd[i]
        bwd[i - 1] = (t[1, 0] + t[1, 1] * b) / (t[0, 0] + t[0, 1] * b)
    return fwd, bwd


def marginals(e, start, length, trans) -> np.ndarray:
    """The marginal of label 1 at each token."""
    fwd, bwd = messages(np.exp(e), start, length, np.exp(trans))
    return fwd * bwd / (1 + fwd * bwd)


def pair_marginals(e, start, length, trans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Also the 2 x 2 marginals of each token and the one before it, and which tokens those are."""
    t, x = np.exp(trans), np.exp(e)
    fwd, bwd = messages(x, start, length, t)
    inner = np.ones(len(x), bool)
    inner[start] = False
    i = np.flatnonzero(inner)
    joint = np.empty((len(i), 2, 2))
    joint[:, 0, 0], joint[:, 0, 1] = t[0, 0], t[0, 1] * x[i] * bwd[i]
    joint[:, 1, 0], joint[:, 1, 1] = fwd[i - 1] * t[1, 0], fwd[i - 1] * t[1, 1] * x[i] * bwd[i]
    return fwd * bwd / (1 + fwd * bwd), joint / joint.sum((1, 2), keepdims=True), i


def apart(texts: list[str]) -> list[int]:
    """The places of texts of which no earlier one is a near copy: by the least hash of three-word shingles."""
    seen, out = set(), []
    for i, t in enumerate(texts):
        w = t.lower().split()
        key = min((zlib.crc32(" ".join(w[k : k + 3]).encode()) for k in range(max(1, len(w) - 2))), default=0)
        if key not in seen:
            seen.add(key)
            out.append(i)
    return out


def _stems(word: str) -> list[str]:
    """The word, and its first letters where it has more (with a mark that no word has)."""
    return [word, *(f"{word[:n]} " for n in STEMS if len(word) > n)]


def lexicon(texts: list[str], labels: np.ndarray) -> set[str]:
    """Words and stems that are far more frequent in toxic documents than chance would have it."""
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    c: dict[str, list[int]] = {}
    for t, y in zip(texts, labels, strict=True):
        for w in {s for x in {x.lower().strip(STRIP) for x in t.split()} for s in _stems(x)}:
            c.setdefault(w, [0, 0])[int(y)] += 1
    share = n1 / (n1 + n0)

    def odds(a: int, b: int) -> float:  # twice the log-likelihood ratio against chance
        n = a + b
        return 2 * (b * np.log(b / (n * share)) + (a * np.log(a / (n * (1 - share))) if a else 0.0))

    return {w for w, (a, b) in c.items() if w and b > 2 and b * (1 - share) > 4 * a * share and odds(a, b) >= SURE}


def fit(texts: list[str], labels: np.ndarray, rounds: int = 60) -> dict:
    """Weights, transitions and the document score's coefficients, by Adam on the chain likelihood."""
    own = apart(texts)
    texts, labels = [texts[i] for i in own], labels[own]
    words = lexicon(texts, labels)
    a, owner, start, length, first = _chains(texts)
    told = lru_cache(None)(lambda x: not words.isdisjoint(_stems(x.lower().strip(STRIP))))
    tags = np.array([told(x) for t in texts for line in t.split("\n") for x in line.split()], float)
    tags *= labels[owner]
    w, trans = np.zeros(DIMS), np.zeros((2, 2))
    m, v = np.zeros(DIMS + 4), np.zeros(DIMS + 4)
    last = np.r_[first[1:], True]
    for step in range(1, rounds + 1):
        p, joint, i = pair_marginals(_emit(a, first, w), start, length, trans)
        d = (tags - p) / len(texts)
        g = sum(np.bincount(a[:, k], d, DIMS) for k in range(OWN))
        g += np.bincount(a[:-1, OWN], np.where(first[1:], 0, d[1:]), DIMS) + np.bincount(a[1:, OWN + 1], np.where(last[:-1], 0, d[:-1]), DIMS)
        seen = np.zeros((2, 2))
        np.add.at(seen, (tags[i - 1].astype(int), tags[i].astype(int)), 1)
        gt = (seen - joint.sum(0)) / len(texts)
        grad = np.r_[g - 1e-4 * w, (gt - 1e-3 * trans).ravel()]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, trans = w + move[:DIMS], trans + move[DIMS:].reshape(2, 2)
    model = {"w": w.astype(np.float32), "trans": trans}
    x = np.c_[np.ones(len(texts)), _document(texts, model)[0]]
    b = np.zeros(x.shape[1])
    for _ in range(200):  # Newton steps of a lightly held logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(len(b))
        b = b + np.linalg.solve(h, x.T @ (labels - q) - 0.05 * b)
    return model | {"b": b}


def _document(texts: list[str], model: dict):
    """For each text log(1 + expected toxic tokens), those for each token, and the largest marginal; and all tokens' marginals."""
    x = np.zeros((len(texts), 3))
    c = _chains(texts)
    if c is None:
        return x, None, None
    a, owner, start, length, first = c
    p = marginals(_emit(a, first, model["w"]).astype(float), start, length, model["trans"])
    expected = np.bincount(owner, p, len(texts))
    x[:, 0] = np.log1p(expected)
    x[:, 1] = 10 * np.sqrt(expected / np.maximum(np.bincount(owner, minlength=len(texts)), 1))
    np.maximum.at(x[:, 2], owner, p)
    return x, p, owner


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, out: int, per_label: tuple[int, int], chars: int, doc_id="doc_id", text="text"):
    """At most per_label texts of each label outside the held-out fold, and their labels; by hash order."""
    use = labels.where(F.col(label).isin(0, 1) & (F.crc32(F.col(doc_id).cast("string").cast("binary")) % fold != out)).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("_y")).where("y = _y")
    short = docs.where(F.length(docs[f"`{text}`"]) <= chars).select(docs[f"`{doc_id}`"].alias("id"))
    texts, ys = [], []
    for y in (0, 1):
        ids = use.where(F.col("y") == y).join(short, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(per_label[y])
        got = docs.select(docs[f"`{doc_id}`"].alias("id"), docs[f"`{text}`"].alias("t")).join(F.broadcast(ids), "id").groupBy("id").agg(F.min("t").alias("t")).orderBy("id").select("t").toPandas()
        texts += [t or "" for t in got["t"]]
        ys += [y] * len(got)
    return texts, np.array(ys, float)


def score(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, held_out, score, predicted and spans, the offending code-point offsets as start:end, comma-joined."""
    import pyarrow as pa

    spark = docs.sparkSession
    texts, y = sample(docs, labels, "toxic", 3, 1, SAMPLE, SAMPLE_CHARS, doc_id, text)
    model = spark.sparkContext.broadcast(fit(texts, y) if 0 < y.sum() < len(y) else None)

    def run(batches):
        m = model.value
        for batch in parts(batches):
            own = [t or "" for t in batch.column("t").to_pylist()]
            spans = [""] * len(own)
            if m is None:
                s = np.zeros(len(own))
            else:
                x, p, owner = _document(own, m)
                s = 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(own)), x] @ m["b"], -30, 30)))
                if p is not None:
                    hot = np.flatnonzero(p >= 0.5)
                    begin = np.searchsorted(owner, np.arange(len(own)))
                    for i in np.unique(owner[hot]):
                        places = [q.span() for q in re.finditer(r"\S+", own[i])]
                        spans[i] = ",".join(f"{places[k - begin[i]][0]}:{places[k - begin[i]][1]}" for k in hot[owner[hot] == i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array(spans, pa.string())], ["doc_id", "score", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("t")).mapInArrow(run, f"doc_id {kind}, score double, spans string")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return d.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "spans")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
