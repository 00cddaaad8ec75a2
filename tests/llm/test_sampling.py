"""Packing, phrases and importance resampling against plain versions, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cuespan.llm import importance, packing, phrases
from cuespan.llm.common import local_file

VOCAB = local_file("word_bpe_49k.json")
ODD = ["a\x1cb c", "x\xa0y\x85z w　q​k", "Straße, ÉTÉ. İstanbul ΑΣ Σ", "éte cafés it's they've I'LL don't,", "<|endoftext|>a<|startoftext|> b<|end", "", "  \n ", "a" * 700 + " x", "3.14 K Å ẞ", None]


def documents(spark, texts, extra=False):
    rows = [(i, t, "en" if i % 3 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3, "doc_id")
    return df.selectExpr("*", "'z' as start", "1 as f", "'q' as t", "7 as n", "2 as block") if extra else df


def mixed(n, seed, words=40):
    r = random.Random(seed)
    vocab = ["a", "of", "the", "New", "york", "city", "x1", "éa", "b-c"] + [f"w{i}" for i in range(words)]
    text = lambda: " ".join(r.choice(["new york city", "of the", ".", ",", "\n", "\t", *r.choices(vocab, k=4)]) for _ in range(r.randint(0, 60)))
    return [*[text() for _ in range(n)], *ODD]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    t.no_truncation()
    t.no_padding()
    return t


def test_words_give_the_librarys_ids(tokenizer, monkeypatch):
    w = packing.Words(VOCAB)
    for size in (10_000_000, 50):
        monkeypatch.setattr(packing, "WORDS", size)  # the table is emptied again and again
        texts = [t or "" for t in mixed(40, 1)]
        for got, t in zip(w.ids(texts), texts, strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "BLOCK", 100)
    long = " ".join(t or "" for t in mixed(60, 2))
    assert np.frombuffer(w.ids([long])[0], "<u4").tolist() == tokenizer.encode(long, add_special_tokens=False).ids


def test_pieces_cover_each_document_once(spark, tokenizer, monkeypatch):
    texts = [*mixed(60, 3), "one two three. " * 2000, "zq " * 9000, "one two three. " * 2000]
    out = packing.pack(documents(spark, texts, extra=True), VOCAB)
    got = out.collect()
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for d, own in by_doc.items():
        ids = tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)
    s = packing.sequences(out).collect()
    assert sum(r.padding for r in s) == 0 and sum(r.used for r in s) == sum(r.length for r in got)
    assert packing.pack(documents(spark, texts).limit(0), VOCAB).count() == 0


def test_rests_go_to_the_cheapest_sequence_with_room():
    g, r = packing.Group(0), random.Random(5)
    sizes = [r.randint(1, 900) for _ in range(300)]
    for k, n in enumerate(sizes):
        g.add(k, 0, n)
    room = [2048] * (sum(sizes) // 2048)
    placed = list(g.pack(room))
    left, spent = dict.fromkeys(range(len(room)), 2048), dict.fromkeys(range(len(room)), 0.0)
    want, rest = [], []
    for n, k in sorted(((n, k) for k, n in enumerate(sizes)), key=lambda x: (-x[0], x[1])):
        a = 0
        while a < n:
            fits = [s for s in left if left[s] >= n - a] or [s for s in left if left[s]]
            if not fits:
                rest.append((k, a, n))
                break
            s = min(fits, key=lambda s: (spent[s], s))
            m = min(n - a, left[s])
            want.append((k, a, a + m, s, 2048 - left[s]))
            left[s] -= m
            spent[s] += packing.cost(m)
            a += m
    assert placed == want and g.rests == rest and not any(left.values())
    cost = [*spent.values()]
    assert max(cost) < 1.25 * min(cost)


def plain_phrases(rows, least, words):
    f, n = Counter(), Counter()
    for lang, t in rows:
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, words + 1):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return {p: c for p, c in f.items() if c >= least}, n


def plain_collocations(rows, least, words, best, inside=100):
    f, n = plain_phrases(rows, least, words)
    by = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        if any(m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= inside * a for (m, q), b in f.items()):
            continue
        s, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        by.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, own in by.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:best], 1)}


@pytest.mark.parametrize(("least", "best", "inside", "buckets", "block"), [(5, 2000, 100, 1 << 22, 200_000), (3, 40, 60, 1 << 14, 50), (2, 2000, 100, 1 << 15, 700)])
def test_collocations_are_the_plain_ones(spark, monkeypatch, least, best, inside, buckets, block):
    texts = [*mixed(150, least), "to be or not to be " * 40, "Of The, of the;" * 30]
    df = documents(spark, texts, extra=True)
    for name, value in (("BLOCK", block), ("HELD", 60), ("ROW", 64)):  # these go to the workers with the function
        monkeypatch.setattr(phrases, name, value)
    got = {tuple(r) for r in phrases.collocations(df, least, best=best, inside=inside, buckets=buckets).collect()}
    want = plain_collocations([("en" if i % 3 else None, t) for i, t in enumerate(texts)], least, 5, best, inside)
    assert got == want and len(want) > 20


def test_collocations_of_nothing(spark):
    df = documents(spark, ["a b", None, "", "b"])
    assert phrases.collocations(df).count() == 0
    assert phrases.collocations(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(df, least=0)


def test_saturated_counters_pass_what_plain_counts_would():
    b = phrases.Buckets(1 << 16)
    h = np.array([1 << 7, 5 << 40, (1 << 63) + 77], np.uint64)
    for _ in range(3):
        b.add(np.repeat(h, [180, 60, 1]))
    at = phrases._mixed(h, 1 << 16)
    assert len(set(at)) == 3 and b.counts[at].tolist() == [255, 180, 3]
    back = {(k * phrases.RANGE + p, c) for k, places, counts in b.rows() for p, c in zip(np.frombuffer(places, "<u2").tolist(), counts, strict=True)}
    assert back == {*zip(at.tolist(), [255, 180, 3], strict=True)}
    bits = phrases.Bits(np.packbits(b.counts >= 100).tobytes())
    assert bits[h].tolist() == [True, True, False]


def plain_importance(docs, target, longest, least_words, percent):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda w: [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    bucket = lambda x: zlib.crc32(x.encode()) % 10_000
    own = [(i, words(t)) for i, t in docs]
    feats = [(i, w, [bucket(x) for x in runs(w)]) for i, w in own]
    s, t = Counter(), Counter()
    for _, _, b in feats:
        s.update(b)
    for x in target:
        t.update(bucket(y) for y in runs(words(x)))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, w, b in feats:
        g = sum(math.floor(1000 * math.log(float(t[x] + 1) * float(big_s + 10_000) / (float(s[x] + 1) * float(big_t + 10_000)))) for x in b)
        weight = g // len(b) if b else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((x for x in out if x[1] >= least_words), key=lambda x: (-x[4], x[0]))
    rank = {x[0]: k for k, x in enumerate(may[: len(may) * percent // 100], 1)}
    return sorted((i, n, weight, score, rank.get(i)) for i, _, n, weight, score in out)


@pytest.mark.parametrize(("longest", "block"), [(1, 4096), (2, 7)])
def test_resampling_is_the_plain_one(spark, monkeypatch, longest, block):
    texts = [*mixed(120, 8), "w1 " * 5000, "New York"]
    target = ["new york city of the", "w1 w2 w3", None, "", "x1 new york"]
    monkeypatch.setattr(importance, "DOCS", block)  # sizes come with the function
    monkeypatch.setattr(importance, "PART", 2)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(documents(spark, texts, extra=True), goal, percent=30, least_words=8, longest=longest)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == plain_importance([*enumerate(texts)], target, longest, 8, 30)


def test_resampling_of_nothing(spark):
    df = documents(spark, ["a b", None, "", "b"])
    none = spark.createDataFrame([], "text string")
    assert importance.resample(df.limit(0), none).count() == 0
    got = importance.resample(df.union(df).selectExpr("if(doc_id = 3, null, doc_id) as doc_id", "text"), none).collect()
    assert len(got) == 8 and all(r["rank"] is None for r in got)
    assert sorted(r.n_features for r in got) == [0, 0, 0, 0, 1, 1, 2, 2]


def test_components_of_a_chain_in_order(spark, monkeypatch):
    from cuespan.llm import components

    n, own = [0], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: n.__setitem__(0, n[0] + 1) or own(df, name))
    links = spark.range(3000).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(9000, 7000), (8000, 9000)], "a long, b long"))
    got = components.components(links)
    assert sorted(map(tuple, got.groupBy("comp").count().collect())) == [(0, 3001), (7000, 3)] and n[0] < 30


def test_warc_members_and_ranges(spark, tmp_path):
    """Each record is a gzip member; a file is read by ranges of members."""
    import gzip
    import json
    import os
    import zlib

    from cuespan.llm import warc

    rows = [(k, f"http://x/{k}", f"<p>{k}</p>" * (k * 9)) for k in range(60)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w", segment=700)
    files = [x for x in os.listdir(tmp_path / "w") if x.endswith(".warc.gz")]
    assert len(files) == 1
    raw = (tmp_path / "w" / files[0]).read_bytes()
    at, members = 0, []
    while at < len(raw):
        member = zlib.decompressobj(31)
        members.append((at, member.decompress(raw[at:])))
        at = len(raw) - len(member.unused_data)
    assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") and m.count(b"WARC-Record-ID") == 1 for _, m in members) and len(members) > 60
    assert gzip.decompress(raw) == b"".join(m for _, m in members)
    index = next(tmp_path / "w" / x for x in os.listdir(tmp_path / "w") if x.startswith("_index"))
    own = json.loads(index.read_text())
    assert own["ranges"] == [[0]] and own["end"] == len(raw)
    want = sorted((r.page_id, r.payload_bytes) for r in warc.read(spark, f"file://{tmp_path}/w").collect())
    index.write_text(json.dumps(own | {"ranges": [[p] for p, _ in members[::10]]}))
    parts = spark.read.format("warc").load(f"file://{tmp_path}/w")
    assert parts.rdd.getNumPartitions() == -(-len(members) // 10)
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read(spark, f"file://{tmp_path}/w").collect()) == want == [(k, len(h)) for k, _, h in rows]


def test_licence_lines_lose_none_to_the_bound(spark):
    """Files of one line: every one that reaches the threshold is found, without any filter in the plain version."""
    from cuespan.llm import licenses

    r = random.Random(12)
    cut = lambda x: [w for w in re.split(r"[\W_]+", x.lower()) if w]
    texts = [cut(t) for _, t in licenses.TEMPLATES]
    files = []
    for k in range(250):
        t = r.choice(texts)
        own = t[: r.randint(3, len(t))]
        own = [w for w in own if r.random() < 0.9] + [f"foreign{r.randrange(40)}" for _ in range(r.randint(0, len(own)))]
        files.append((k, " ".join(own)))
    templates = spark.createDataFrame(licenses.TEMPLATES, "licence string, text string")
    got = {x.key: x.cosine for x in licenses.own_licences(spark.createDataFrame(files, "key long, text string"), templates).collect()}
    known, total = {w for t in texts for w in t}, len(files)
    df = Counter(w for _, t in files for w in set(cut(t)) & known)
    vec = lambda ws: {w: (1 + math.log(n)) * (1 + math.log((1 + total) / (1 + df[w]))) for w, n in Counter(ws).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for k, t in files:
        v = vec(cut(t))
        best = max(sum(x * u.get(w, 0) for w, x in v.items()) / (size(v) * size(u)) for u in map(vec, texts))
        if round(best, 6) >= licenses.THRESHOLD:
            want[k] = best
    assert got.keys() == want.keys() and 20 < len(want) < len(files) and all(abs(got[k] - want[k]) < 1e-5 for k in got)
