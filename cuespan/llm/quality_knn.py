"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A document's terms are its words, the shapes of its tokens (letters and digits folded, marks kept) and
a few binned ratios (distinct words, doubled words, repeated lines, capitals, marks, length). Hashed
counts are damped and weighted by rarity, and each block has length one. A truncated singular value
decomposition of the training sample gives RANK latent directions. The sample's vectors go to all
tasks; each task multiplies blocks of documents with all of them, so every cosine is exact, and the
NEAR most similar vote with weights of their similarity.

The sample is bounded (SAMPLE documents of label 0 and 1 at most, of at most SAMPLE_CHARS characters,
by hash order outside the held-out fold); so is what is sent to the tasks: a DIMS x RANK projection
and one vector for each sample row. The weights by rarity are part of this fit. Every document is
scored whole in one pass over the scan, without a shuffle. Defined cases: null and empty texts have
the length bin as their only term and are voted on like others; where only one label can be learned
it is everyone's score, where none can, 0; repeated rows score alike; ids with both labels teach nothing, of
different texts under a labelled id the least one in order does; of neighbours whose cosines are equal but for
rounding any may vote at the edge, in the same way for equal batches; columns of any names may stand beside; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, table
from .toxicity import STRIP, apart, sample

SAMPLE, SAMPLE_CHARS, WORDS, SHAPES, RATIOS, RANK, NEAR = (2_000, 1_500), 20_000, 3072, 768, 256, 64, 25
DIMS = WORDS + SHAPES + RATIOS
BLOCKS = ((0, WORDS, 0.5), (WORDS, WORDS + SHAPES, 1.0), (WORDS + SHAPES, DIMS, 1.0))


@lru_cache(500_000)
def _terms(token: str) -> int:
    """The token's word and shape as columns of 16 bits each; then a bit for capitals and one for marks."""
    word = token.lower().strip(STRIP)
    folded = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a", token)
    shape = re.sub(r"(.)\1{2,}", r"\1\1", re.sub(r"\d+", "0", folded))[:12]
    marked = any(c in "#*$%&|<>!" for c in token)
    return zlib.crc32(word.encode()) % WORDS | (WORDS + zlib.crc32(shape.encode()) % SHAPES) << 16 | (token.isupper() and len(token) > 1) << 32 | marked << 33


def counts(texts: list[str]) -> np.ndarray:
    """Damped counts of all terms, a row for each text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        tokens = t.split()
        n = len(tokens)
        row = out[i]
        ratios = [min(31, int(np.log2(n + 1) * 2))]
        if n:
            f = np.fromiter(map(_terms, tokens), np.int64, n)
            row += np.log1p(np.bincount(f & 0xFFFF, minlength=DIMS) + np.bincount(f >> 16 & 0xFFFF, minlength=DIMS))
            lines = [x for x in t.split("\n") if x]
            doubled = np.count_nonzero(f[1:] == f[:-1])
            shares = [len(set(tokens)) / n, doubled / n, 1 - len(set(lines)) / max(1, len(lines)), (f >> 32 & 1).mean(), (f >> 33).mean()]
            ratios += [32 * (k + 1) + min(20, int(s * 20)) for k, s in enumerate(shares)]
        for r in ratios:  # a neighbouring bin counts in part
            row[WORDS + SHAPES + r] += 1.0
            if r % 32 < 31:
                row[WORDS + SHAPES + r + 1] += 0.5
    return out


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = c * idf
    for a, b, w in BLOCKS:
        x[:, a:b] *= w / np.maximum(np.linalg.norm(x[:, a:b], axis=1, keepdims=True), 1e-9)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(texts: list[str], labels: np.ndarray) -> dict:
    own = apart(texts)
    c, y = counts([texts[i] for i in own]), labels[own]
    idf = np.log((1 + len(c)) / (1 + (c > 0).sum(0))).astype(np.float32) + 0.1
    x = weighted(c, idf)
    rank = min(RANK, *x.shape)
    basis = np.random.default_rng(7).standard_normal((DIMS, min(rank + 16, len(x)))).astype(np.float32)
    for _ in range(4):  # subspace iteration towards the leading right singular vectors
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    turn = np.linalg.svd(x @ basis, full_matrices=False)[2]
    project = (basis @ turn.T)[:, :rank].astype(np.float32)
    return {"idf": idf, "project": project, "vectors": _unit(x @ project).astype(np.float32), "y": y.astype(np.float32)}


def vote(texts: list[str], m: dict) -> np.ndarray:
    """The share of label 1 among the nearest sample vectors, weighted by similarity."""
    q = _unit(weighted(counts(texts), m["idf"]) @ m["project"])
    cos = q @ m["vectors"].T
    near = min(NEAR, cos.shape[1])
    at = np.argpartition(-cos, near - 1, axis=1)[:, :near]
    w = np.maximum(np.take_along_axis(cos, at, 1), 0) ** 4 + 1e-6
    return (w * m["y"][at]).sum(1) / w.sum(1)


def score(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    import pyarrow as pa

    spark = docs.sparkSession
    texts, y = sample(docs, labels, "quality", 4, 2, SAMPLE, SAMPLE_CHARS, doc_id, text)
    only = float(y[0]) if len(y) else 0.0
    model = spark.sparkContext.broadcast(fit(texts, y) if 0 < y.sum() < len(y) else None)

    def run(batches):
        m = model.value
        for b in parts(batches, 256):
            own = [t or "" for t in b.column("t").to_pylist()]
            s = np.full(len(own), only) if m is None or not own else vote(own, m)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.clip(s, 0, 1).astype(float), pa.float64())], ["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("t")).mapInArrow(run, f"doc_id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return d.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op1_quality_knn(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
