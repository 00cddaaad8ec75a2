"""Each text operator against a plain version, with nulls, empty and long texts, ties, repeats, empty
tables and extra columns whose names clash with the operators' own."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuespan.llm import bpe, common, components, jaccard, licenses, lpf_dedup, pii, quality_knn, quality_rules, toxicity, warc, winnow

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve the and of to a in".split()


def prose(rnd, n):
    return " ".join("".join(rnd.choice(VOCAB) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def corpus():
    rnd = random.Random(5)
    base = [prose(rnd, rnd.randint(5, 300)) for _ in range(25)]
    texts = [*base, base[0], base[0], base[3] + " tail words", None, "", "one two", "one  TWO", "x" * 3000, "é " * 80, "ab" * 400]
    for b in base[:8]:
        w = b.split()
        for _ in range(3):
            v = list(w)
            for _ in range(max(1, len(v) // 60)):
                v[rnd.randrange(len(v))] = rnd.choice(VOCAB)
            texts.append(" ".join(v))
    return [(k, t, "en", "src", 0) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame([*rows, rows[3]], DOCS).repartition(3)


@pytest.fixture(scope="module")
def odd(docs):
    """docs with columns whose names clash with the operators' own."""
    return docs.withColumns({c: F.lit("clash") for c in ("id", "t", "th", "w", "row", "n", "spans", "kept", "comp", "key", "places", "_drop_id", "h", "lines")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def oracle(rows, sql, **tables):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    for name, (columns, own) in tables.items():
        con.execute(f"create table {name} ({columns})")
        con.executemany(f"insert into {name} values ({', '.join('?' * len(own[0]))})", own)
    return con.execute(sql)


# rules ------------------------------------------------------------------------------------------


def test_rules(spark, docs, odd, none):
    rows = corpus()
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = quality_rules.judge(odd).select(F.col("row.doc_id").alias("doc_id"), *cols[1:])
    want = oracle(rows, quality_rules.SQL).fetchall()
    assert sorted({tuple(r) for r in got.collect()}) == sorted(want)
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(odd).columns == odd.columns
    junk = spark.createDataFrame([(1, " ".join(["buy*** now$$$"] * 60)), (2, "a b c\n" * 40)], "doc_id long, text string")
    assert quality_rules.keep_good(junk).count() == 0


def test_clean_documents_are_kept(spark):
    """No row labelled clean goes by repeated lines or few distinct words, nor does a very long text; repeats do."""
    sf = "/root/testdata/sf0.1"
    clean = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    broken = quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet").join(clean, "doc_id", "left_semi"), rules=quality_rules.FAIR_RULES).where("n_words >= 50")
    assert broken.count() > 3000 and broken.where("array_contains(broken, 'repeated_lines') or array_contains(broken, 'few_distinct_words')").count() == 0
    rnd = random.Random(3)
    vocabulary = [prose(rnd, 1) + str(k) for k in range(3000)]
    long = " ".join(rnd.choice(vocabulary) for _ in range(40_000))
    junk = "\n".join([" ".join(vocabulary[:60]), *["buy it now all of you"] * 40])
    rows = [(1, long), (2, junk), (3, " ".join(vocabulary[:20]) + " the and\n" + "of it\nof it\n" + " ".join(vocabulary[20:60]))]
    assert {r.doc_id for r in quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 3}


# similarity -------------------------------------------------------------------------------------


def brute_components(rows):
    def shingles(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    s = {i: shingles(t) for i, t, *_ in rows}
    comp = {i: i for i in s}
    for _ in range(len(s)):
        for a in s:
            for b in s:
                if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(s[i]), comp[i]) for i in s}


def test_jaccard(docs, odd, none):
    got = {r.id: (r.n, r.component) for r in jaccard.classes(odd).collect()}
    assert got == brute_components(corpus())
    kept = {r.doc_id for r in jaccard.keep_one(odd).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}
    assert jaccard.classes(none).count() == 0


def test_jaccard_of_hot_shingles(spark, monkeypatch):
    """Shared lines make shingles heavy; their groups are cut into blocks."""
    rnd = random.Random(9)
    line = prose(rnd, 12)
    rows = [(k, f"{line} {prose(rnd, rnd.randint(3, 40))}", "", "", 0) for k in range(60)]
    rows += [(100 + k, f"{line} {rows[k][1]} more", "", "", 0) for k in range(0, 60, 7)] + [(200 + k, line + " z" * (k % 3), "", "", 0) for k in range(9)]
    monkeypatch.setattr(jaccard, "heavy_shingles", lambda d, total: np.sort(jaccard.Shingler()(line)))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    df = spark.createDataFrame(rows, DOCS)
    assert {r.id: (r.n, r.component) for r in jaccard.classes(df).collect()} == brute_components(rows)


def test_trees_lose_no_link():
    rng = np.random.default_rng(0)
    for _ in range(25):
        base = [rng.integers(0, 2**62, rng.integers(1, 300)).astype(np.uint64) for _ in range(4)]
        own = []
        for _ in range(rng.integers(2, 90)):
            b = base[rng.integers(4)].copy()
            k = rng.integers(0, len(b) // 4 + 1)
            b[:k] = rng.integers(0, 2**62, k).astype(np.uint64)
            own.append(np.unique(b))
        n, bits = np.array([len(s) for s in own]), np.zeros((len(own), jaccard.BITS), bool)
        for k, s in enumerate(own):
            bits[k, (s % np.uint64(jaccard.BITS)).astype(int)] = True
        bits = np.packbits(bits, axis=1).view(np.uint64)
        cut = rng.integers(1, len(own))
        for trees in (np.zeros(len(own), int), (np.arange(len(own)) >= cut).astype(int)):
            x = np.zeros(1, int)
            a, b = jaccard.traverse(jaccard.Forest(trees, n, bits), x, x + trees.max())
            got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
            want = {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if (trees.max() == 0 or trees[i] != trees[j]) and jaccard.links(own[i], own[j])}
            assert want <= got and len(got) == len(a)


def test_trees_bring_the_links_of_the_corpus(spark):
    """On the given documents both rounds' candidates come out of trees, and the first round's hold links."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = jaccard.sets(d).where("n > 0")
    nodes = common.stored(known.join(known.groupBy("digest").agg(F.min("id").alias("id")), ["id", "digest"], "left_semi"), "nodes")
    first = jaccard.first_pairs(nodes)
    assert 0 < jaccard.verified(first, d).count() <= first.count() < nodes.count()


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(0, 12)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.comp for r in components.components(e).collect()}
    assert all(got[k] == 0 for k in range(13)) and got[101] == got[100] == 100


# repeated strings -------------------------------------------------------------------------------


def brute_kept(rows):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            s = raw[k : k + 100]
            if s in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [lpf_dedup.HOT, 2])
def test_lpf(odd, none, hot, monkeypatch):
    """Also with most anchors hot, and with entries that go to files and come back in many ranges."""
    if hot == 2:
        for name, v in (("SAMPLE", 1), ("HELD", 1000), ("SORTED", 100), ("RUN", 200)):
            monkeypatch.setattr(lpf_dedup, name, v)
    d = odd.select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    assert (len(lpf_dedup.hot_anchors(d, hot)) > 20) == (hot == 2)
    got = {r.doc_id: tuple(r)[1:5] for r in lpf_dedup.cleaned(odd, hot=hot).collect()}
    assert got == brute_kept(corpus())
    assert lpf_dedup.cleaned(none).count() == 0


def test_previous_factors_are_the_longest():
    """Against all pairs of places, over few letters, so that factors end anywhere."""
    rnd = random.Random(6)
    base = [bytes(rnd.choice(b"ab") for _ in range(168)) for _ in range(6)]
    contexts, ids, starts = [], [], []
    for k in range(40):
        b = bytearray(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            b[rnd.randrange(168)] ^= 1
        a = rnd.randrange(40)
        contexts.append(bytes(b[a : a + rnd.randint(90, 168)]))
        ids.append(rnd.randrange(12))
        starts.append(1000 * k)
    own, place, factor = lpf_dedup.previous_factors(contexts, np.array(ids), np.array(starts))
    strings = {(i, s + p): c[p:] for c, i, s in zip(contexts, ids, starts, strict=True) for p in range(len(c) - 99)}
    assert {(int(i), int(p)) for i, p in zip(own, place, strict=True)} == set(strings)
    common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    for i, p, f in zip(own.tolist(), place.tolist(), factor.tolist(), strict=True):
        most = max((common(strings[i, p], y) for k, y in strings.items() if k < (i, p)), default=0)
        assert f == (most if most >= 100 else 0)


def test_texts_under_one_id_are_their_own_documents(spark):
    rnd = random.Random(8)
    a, b, c, e = (prose(rnd, 80) for _ in range(4))
    rows = [(1, a), (7, a + " tail words"), (7, b), (9, c), (9, c), (None, a[:150] + e), (None, b[:40] + e[::-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in jaccard.keep_one(df).collect()) == sorted((i or 0, t) for i, t in rows if t != a + " tail words")
    got = {(r.id, r.n): r.component for r in jaccard.classes(df).collect()}
    assert sorted(v for (i, _), v in got.items() if i == 7) == [1, 7] and all(v is None for (i, _), v in got.items() if i is None)
    out = [(r.doc_id, bytes(r.kept).decode()) for r in lpf_dedup.cleaned(df).collect()]
    # the null ids come first and lose nothing; the copies of their 150 bytes go
    assert {t for i, t in out if i is None} == {t for i, t in rows if i is None}
    assert (7, b) in out and out.count((9, c)) == 2 and (7, " tail words") in [(i, t[-11:]) for i, t in out] and (1, a[150:]) in out


# benchmark --------------------------------------------------------------------------------------


@pytest.mark.parametrize("dealt", [False, True])
def test_winnowing(spark, docs, odd, none, dealt, monkeypatch):
    if dealt:
        monkeypatch.setattr(winnow, "BROADCAST_ROWS", 0)
    rows = corpus()
    long, other = rows[2][1].split(), rows[9][1].split()
    items = [(1, " ".join(long[5:40]).upper()), (2, "of to the"), (3, " ".join(other[:9])), (4, None), (5, "!!"), (6, prose(random.Random(1), 30)), (7, " ".join(long[5:40]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1))
    got = {tuple(r) for r in winnow.report(odd, bench).collect()}
    want = oracle(rows, winnow.SQL, benchmark=("item_id bigint, text varchar", items)).fetchall()
    assert got == set(want) and any(r[-1] for r in want)
    clean = winnow.drop_contaminated(odd, bench)
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in want if not r[-1]} and clean.columns == odd.columns
    names = odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {tuple(r)[1:] for r in winnow.report(names, bench).collect()} == {r[1:] for r in want}
    assert winnow.report(none, bench).count() == 0 and winnow.report(docs, bench.limit(0)).where("contaminated").count() == 0


# personal data ----------------------------------------------------------------------------------

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(t):
    out = []
    for k, (name, p) in enumerate(PATTERNS):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            total = sum((2 * int(c) - 9 * (int(c) > 4) if j % 2 else int(c)) for j, c in enumerate(reversed(d)))
            if name == "email" or name == "ip" and all(int(x) < 256 for x in m[0].split(".")) or name == "card" and 12 <= len(d) <= 19 and total % 10 == 0 or name == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_pii_base(spark, odd, none):
    rnd = random.Random(2)
    bits = ["a@b.co", "x_%@é", "1.2.3.4", "256.1.1.1", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111-1111-1111-1112", ".", "é漢🙂", "5", "-", " ", "@q.r.s", "+49", "\n"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25))) for _ in range(300)] + ["9" * 20_000 + " " + "a" * 30_000 + "@", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.report(df).collect():
        want = plain_spans(texts[r.doc_id]) if len(texts[r.doc_id] or "") < 10_000 else ""
        base = ",".join(s for s in r.spans.split(",") if not s.startswith("term"))
        assert base == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert r.n_email == want.count("email") and r.n_card == want.count("card")
    assert pii.report(none).count() == 0 and pii.sanitise(odd).columns == odd.columns and pii.report(odd).count() == odd.count()


def told_terms(rows, total):
    """Plain: (doc, start, end, action) of terms, and n_t, of rows (id, text) with unique ids and no overlapping base spans."""
    from collections import Counter
    from math import log2

    word = re.compile(r"[^\W\d_][^\W_]{2,}")
    ents, words, n_t = {}, {}, Counter()
    for i, t in rows:
        n_t.update({m[0].lower() for m in word.finditer(t or "")})
        blank = t or ""
        for s in filter(None, plain_spans(t).split(",")):
            kind, a, b = s.split(":")
            a, b = int(a), int(b)
            v = t[a:b].lower() if kind == "email" else t[a:b] if kind == "ip" else re.sub("[^0-9]", "", t[a:b])
            ents.setdefault((kind, v), set()).add(i)
            blank = blank[:a] + " " * (b - a) + blank[b:]
        words[i] = [(m[0].lower(), m.start(), m.end()) for m in word.finditer(blank)]
    out, n_e = {}, {e: len(d) for e, d in ents.items()}
    for e, d in ents.items():
        both = Counter(w for i in d for w in {x for x, _, _ in words[i]})
        for w, n in both.items():
            pmi, ic = log2((n + 0.5 * n_e[e] / total) / (n_t[w] + 0.5) * total / n_e[e]), log2(total / n_e[e])
            if ic > 0 and pmi >= pii.GENERALISE * ic:
                for i in d:
                    for x, a, b in words[i]:
                        if x == w:
                            act = "remove" if pmi >= pii.REMOVE * ic else "generalise"
                            out[i, a, b] = max(act, out.get((i, a, b), ""))
    return out, n_t


def test_pii_disclosure(spark):
    rows = [(k, f"filler number{k} words here and the project zephyrine is led by ann@corp.example today at {k}") for k in range(5)]
    rows += [(100 + k, f"the project is by today here at words and led number filler {k} bob{k}@x.org") for k in range(60)] + [(300, "the zephyrine again"), (301, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars long")
    got = by_id(pii.report(df))
    want = oracle([(i, t, "", "", 0) for i, t in rows], pii.SQL).fetchall()
    assert sorted(tuple(r) for r in got.values()) == sorted(want)
    told, _ = told_terms(rows, len(rows))
    for i, _ in rows:
        assert sorted(f"term:{a}:{b}" for k, a, b in told if k == i) == sorted(s for s in got[i].spans.split(",") if s.startswith("term"))
    assert any(k == 0 for k, _, _ in told) and got[300].spans == ""
    clean = by_id(pii.sanitise(df))
    assert "zephyrine" not in clean[0].text and "<EMAIL>" in clean[0].text and clean[0].n_chars == len(clean[0].text)
    assert clean[300].text == "the zephyrine again" and clean[301].text is None
    names = df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.doc_id: r.spans for r in pii.report(names).collect()} == {f"d{i}": r.spans for i, r in got.items()}


def test_pii_terms_of_entities_in_one_text(spark):
    """Each place of a rare word in an entity's only document is told, however far from the entity; a word of a
    few documents becomes a beginning that many share."""
    rows = [(k, f"the project is by today here at words and zebra{k} {k}", 0) for k in range(200)]
    rows += [(500, "Zephyrine is here " + "the project is by today " * 20 + "éann@x.org and 10.0.0.1 zephyrine, zeppelin.", 0), (501, "the zephyr words zeppelin", 0), (502, None, 0)]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, n_chars long")
    clean = by_id(pii.sanitise(df))
    assert clean[500].text == "zeph* is here " + "the project is by today " * 20 + "é<EMAIL> and <IP> zeph*, zeppelin." and clean[500].n_chars == len(clean[500].text)
    assert all(clean[i].text == t for i, t, _ in rows if i != 500)
    assert pii.sanitise(df.limit(0)).count() == 0


def test_pii_terms_of_the_given_documents(spark):
    """The whole report and the masked texts against a plain version, on the smallest tables."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    base = [(i, t) for i, t in texts.items()]
    told, _ = told_terms(base, len(base))
    got = by_id(pii.report(d))
    for i, t in base:
        own = sorted((int(s.split(":")[1]), s.split(":")[0] == "term", s) for s in filter(None, [*plain_spans(t).split(","), *(f"term:{a}:{b}" for k, a, b in told if k == i)]))
        assert sorted(got[i].spans.split(",")) == sorted(s for _, _, s in own) or not own and got[i].spans == ""
    assert len({i for i, _, _ in told}) > 5
    clean = by_id(pii.sanitise(d))
    assert all(clean[i].text == t for i, t in base if not got[i].spans)


# BPE --------------------------------------------------------------------------------------------


def test_bpe(spark, docs, none):
    from tokenizers import Tokenizer

    path = common.local_file("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rnd = random.Random(1)
    texts = [t for _, t, *_ in corpus()] + ["<|endoftext|>abc<|startoftext|>", "a'" * 900, "don't'sss'rexx" * 60, "".join(rnd.choice("abcde") for _ in range(9000)), "H̱" * 600, "　".join(["abc"] * 200), "the" * 2000 + "<|endoftext|>" + "an" * 2000, "İ" * 500, "a b\x1cc\x85d " * 50, "漢字" * 2000]
    texts += ["".join(rnd.choice(["tion", "ing", "the", "er", "st", "é"]) for _ in range(rnd.randint(100, 900))) for _ in range(20)]
    df = spark.createDataFrame([(k, t) for k, t in [*enumerate(texts), (3, texts[3])]], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("t", "ids", "n_tokens")})
    enc = bpe.decode(bpe.encode(df, path, with_ids=True), path)
    for r in enc.collect():
        e = plain.encode(texts[r.doc_id] or "", add_special_tokens=False)
        text = plain.decode(e.ids, skip_special_tokens=False)
        assert r.ids == e.ids and r.n_tokens == len(e.ids) and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(none, path).count() == 0 and enc.count() == len(texts) + 1


def test_bpe_joins_of_whole_texts(spark):
    """The given documents go through joins of halves; with tiny leaves cuts fall everywhere."""
    from tokenizers import Tokenizer

    path = common.local_file("word_bpe_49k.json")
    plain, c = Tokenizer.from_file(path), bpe.Codec(path)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert c.encode(texts) == want and c.joins > 100
    rnd = random.Random(4)
    bits = ["tion", "ing", " ", "'s", "é", "e\u0301", "\u0301", "  ", "\n", "<|endoftext|>", "the", "漢字", "!!", "12", "\u3000", "\x85", "ſ", "İ", "Σ", " ΑΣ", "\t", "a"]
    odd_texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 400))) for _ in range(200)] + ["", " ", "x" * 700]
    for leaf in (7, 50):
        assert c.encode(odd_texts, leaf) == [e.ids for e in plain.encode_batch(odd_texts, add_special_tokens=False)]
    assert [c.decode(e) for e in want] == [plain.decode(e, skip_special_tokens=False) for e in want]


# WARC -------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    rnd = random.Random(3)
    big = prose(rnd, 3000) + "é漢\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/ b", big), (2, "u", big), (9, "u", big), (3, None, None), (4, "", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", prose(rnd, 500)), (None, "u", big), (9, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("d", F.lit(1)).withColumn("last", F.lit(2))
    warc.write(pages, f"file://{tmp_path}/w", segment=1000)
    got = warc.read(spark, f"file://{tmp_path}/w").collect()
    want = [(i, "revisit" if h == big and i != 9 else "response", len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), 9 if h == big and i != 9 else None) for i, _, h in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((r[:5] for r in got), key=key) == sorted(want, key=key)
    warc.write(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    ids = [warc.record_id(*a) for a in ((1, "ab"), (1, "ab", 2), (2, "ab"))]
    assert ids[0] == warc.record_id(1, "ab") and len(set(ids)) == 3


def test_warc_of_one_member_a_record(spark, tmp_path):
    """Archives as crawlers write them: a gzip member for each record, other kinds of records, no private headers."""
    import gzip

    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + b"<p>" * 900_000
    cut = [body[:1_000_000], body[1_000_000:]]
    own = [f"WARC/1.0\r\nWARC-Type: {k}\r\nWARC-Record-ID: <urn:{i}>\r\nWARC-Target-URI: http://x/{i}\r\n{more}Content-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for i, (k, more, b) in enumerate([
        ("warcinfo", "", b"software: x"), ("response", "", body), ("request", "", b"GET / HTTP/1.1\r\n\r\n"),
        ("response", "WARC-Segment-Number: 1\r\n", cut[0]), ("continuation", f"WARC-Segment-Number: 2\r\nWARC-Segment-Origin-ID: <urn:3>\r\nWARC-Segment-Total-Length: {len(body)}\r\n", cut[1]), ("response", "", b"HTTP/1.1 200 OK\r\n\r\nsmall"),
    ])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in own))
    (tmp_path / "in" / "b.warc").write_bytes(b"".join(own[-1:]))
    got = sorted((r.target_uri, r.payload_bytes, r.payload_digest) for r in warc.read(spark, f"file://{tmp_path}/in").collect())
    want = [("http://x/1", b"<p>" * 900_000), ("http://x/3", b"<p>" * 900_000), ("http://x/5", b"small"), ("http://x/5", b"small")]
    assert got == sorted((u, len(b), hashlib.sha1(b).hexdigest()) for u, b in want)
    pieces = lambda data: [data[k : k + 7] for k in range(0, len(data), 7)]
    assert [b for _, b in warc.parse(pieces(own[0] + own[5]))] == [b"software: x", b"HTTP/1.1 200 OK\r\n\r\nsmall"]
    with pytest.raises(ValueError):
        list(warc.parse([own[0][:-8]]))
    with pytest.raises(ValueError):
        list(warc.inflated(gzip.compress(own[0])[:-12]))


# classifiers ------------------------------------------------------------------------------------


def labelled(spark, bad):
    rnd = random.Random(8)
    rows = [(k, bad(rnd, prose(rnd, rnd.randint(30, 120))) if k % 3 == 0 else prose(rnd, rnd.randint(30, 120))) for k in range(400)] + [(900, None), (901, "")]
    y = [(k, 0 if k % 3 == 0 else 1, 1 if k % 3 == 0 else 0) for k in range(400)] + [(902, None, None)]
    rows += [rows[0], rows[0], (903, "word " * 60_000), (None, rows[1][1])]  # repeats, a very long text, no id
    y += [(0, 0, 1), (1, 0, 0)]  # a row again, and one that contradicts
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "t", "y", "score", "quality", "toxic")}), spark.createDataFrame(y, "doc_id long, quality int, toxic int")


def test_quality(spark, none):
    d, y = labelled(spark, lambda r, t: " ".join(w + "***" for w in t.split()))
    got = by_id(quality_knn.score(d, y))
    held = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert len(got) == 404 and len(held) > 50 and np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.95
    rows = quality_knn.score(d, y).collect()
    assert len(rows) == d.count() and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id == 0}) == 1
    # against all pairs of vectors, one by one
    texts, ys = toxicity.sample(d, y, "quality", 4, 2, quality_knn.SAMPLE, quality_knn.SAMPLE_CHARS)
    m = quality_knn.fit(texts, ys)
    for r in rows[:40]:
        t = d.where(F.col("doc_id").eqNullSafe(F.lit(r.doc_id))).first().text
        v = quality_knn._unit(quality_knn.weighted(quality_knn.counts([t or ""]), m["idf"]) @ m["project"])[0]
        near = sorted(((float(v @ x), float(k)) for x, k in zip(m["vectors"], m["y"], strict=True)), reverse=True)[: quality_knn.NEAR]
        w = [max(c, 0) ** 4 + 1e-6 for c, _ in near]
        assert abs(r.score - sum(a * k for a, (_, k) in zip(w, near, strict=True)) / sum(w)) < 1e-3
    assert quality_knn.score(none, y).count() == 0 and quality_knn.score(d, y.where("quality = 1")).where("score <> 1").count() == 0


def test_toxicity(spark, none):
    d, y = labelled(spark, lambda r, t: t + " you grimble fool. such a grimble")
    got = by_id(toxicity.score(d, y))
    held = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert len(got) == 404 and np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.95
    rows = toxicity.score(d, y).collect()
    assert len(rows) == d.count() and len({r.score for r in rows if r.doc_id == 0}) == 1
    # against a field that goes token by token
    texts, ys = toxicity.sample(d, y, "toxic", 3, 1, toxicity.SAMPLE, toxicity.SAMPLE_CHARS)
    m = toxicity.fit(texts, ys)
    for k in range(0, 60, 3):
        assert abs(plain_toxicity(by_id(d)[k].text, m) - got[k].score) < 1e-4
    t, spans = by_id(d)[0].text, [tuple(map(int, s.split(":"))) for s in got[0].spans.split(",")]
    assert "grimble" in [t[a:b] for a, b in spans]
    assert toxicity.score(none, y).count() == 0 and toxicity.score(d, y.limit(0)).where("score <> 0").count() == 0


def plain_toxicity(text, m):
    """The score of a text by forward and backward sums over one token after the other."""
    p = []
    for line in text.split("\n"):
        chain = []
        for x in [*line.split(), None]:
            if x is not None:
                chain.append(toxicity._features(x))
            if chain and (x is None or chain[-1][-1]):
                e = [sum(float(m["w"][k]) for k in f[: toxicity.OWN]) for f in chain]
                for k in range(1, len(chain)):
                    e[k] += float(m["w"][chain[k - 1][toxicity.OWN]])
                    e[k - 1] += float(m["w"][chain[k][toxicity.OWN + 1]])
                psi = [np.array([1.0, np.exp(np.clip(v, -30, 30))]) for v in e]
                t = np.exp(m["trans"])
                a, b = [psi[0]], [np.ones(2)]
                for k in range(1, len(psi)):
                    a.append(psi[k] * (a[-1] @ t))
                    b.append(t @ (psi[-k] * b[-1]))
                for f, g in zip(a, b[::-1], strict=True):
                    p.append((f * g)[1] / (f * g).sum())
                chain = []
    x = np.array([1, np.log1p(sum(p)), 10 * np.sqrt(sum(p) / max(1, len(p))), max(p, default=0)])
    return 1 / (1 + np.exp(-x @ m["b"]))


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(1)
    e, trans = rng.normal(size=9), rng.normal(size=(2, 2))
    start, length = np.array([0, 4, 8]), np.array([4, 4, 1])
    p = toxicity.marginals(e, start, length, trans)
    for s, n in zip(start, length, strict=True):
        w = np.zeros((n, 2))
        for k in range(2**n):
            y = [(k >> j) & 1 for j in range(n)]
            v = np.exp(sum(e[s + j] * y[j] for j in range(n)) + sum(trans[y[j - 1], y[j]] for j in range(1, n)))
            for j in range(n):
                w[j, y[j]] += v
        assert np.allclose(p[s : s + n], w[:, 1] / w.sum(1))


# licences ---------------------------------------------------------------------------------------


def plain_licences(files, templates):
    """key -> (licence, cosine) by dictionaries, unit by unit."""
    from collections import Counter
    from math import log, sqrt

    cut = lambda x: [w for w in re.split(r"[\W_]+", x.lower()) if w]
    lines = [(k, n, cut(x)) for k, t in files for n, x in enumerate(re.split(r"\r?\n", t or ""))]
    lines = [x for x in lines if x[2]]
    t = [(name, cut(text)) for name, text in templates]
    known, total = {w for _, ws in t for w in ws}, len(lines)
    df = Counter(w for *_, ws in lines for w in set(ws) & known)
    idf = lambda w: 1 + log((1 + total) / (1 + df[w]))
    vec = lambda ws: {w: (1 + log(n)) * idf(w) for w, n in Counter(ws).items()}
    units = {}
    for k, n, ws in lines:
        own, inside = set(ws) & known, sum(w in known for w in ws)
        if own and sum(idf(w) ** 2 for w in own) * (1 + log(inside - len(own) + 1)) ** 2 >= licenses.SHARE * (1 + log(1 + total)) ** 2 * len(set(ws) - known):
            units.setdefault(k, []).append((n, ws))
    words = {(k, n): ws for k, n, ws in lines}
    best = {}
    for k, own in units.items():
        runs = []
        for n, ws in own:
            if runs and n <= runs[-1][0] + 2:
                runs[-1] = (n, runs[-1][1] + (words.get((k, n - 1), []) if n == runs[-1][0] + 2 else []) + ws)
            else:
                runs.append((n, list(ws)))
        for ws in [ws for _, ws in own] + [ws for _, ws in runs]:
            v = vec(ws)
            for name, tw in t:
                u = vec(tw)
                dot = sum(x * u[w] for w, x in v.items() if w in u)
                c = round(dot / (sqrt(sum(x * x for x in v.values())) * sqrt(sum(x * x for x in u.values()))), 6) if dot else 0
                if c >= licenses.THRESHOLD:
                    best[k] = min(best.get(k, (0, "~")), (-c, name))
    return {k: (name, -c) for k, (c, name) in best.items()}


def test_licences(spark):
    rnd = random.Random(4)
    t = spark.createDataFrame(licenses.TEMPLATES, "licence string, text string").withColumn("w", F.lit("clash"))
    mit = dict(reversed(licenses.TEMPLATES))["MIT"]
    wrapped = "\n".join(" * " + " ".join(mit.split()[k : k + 9]) for k in range(0, len(mit.split()), 9))
    rows = [("a", "x/LICENSE", "Released under the MIT License"), ("b", "x/y/z.py", "code"), ("c", "x/y/w.py", "# Licensed under the Apache License, Version 2.0\ncode"), ("d", "q/z.py", "code"), ("e", "x/y/v.py", None), ("f", None, "Licensed under CC BY-NC 4.0."), ("g", "top.py", "")]
    rows += [("h", "w/deep/er/f.py", "code"), ("i", "w/COPYING", "/*\n" + wrapped + "\n */"), ("j", "w/deep/LICENSE.txt", "Creative Commons Attribution CC BY 4.0"), ("k", "w/other/f.py", prose(rnd, 30_000)), ("l", "w/LICENSE", "GNU General Public License, version 3\nGNU General Public License, version 3")]
    rows += [(f"n{k}", f"n/{k}", "\n".join(prose(rnd, 8) for _ in range(20))) for k in range(40)]
    df = spark.createDataFrame([*rows, rows[2], rows[2]], "key string, path string, text string").withColumns({c: F.lit("clash") for c in ("line", "term", "n", "dir", "c", "licence", "given")})
    got = {r.key: r.licence for r in licenses.scan(df, t).collect() if not r.key.startswith("n")}
    assert got == {"a": "MIT", "b": "MIT", "c": "Apache-2.0", "d": None, "e": "MIT", "f": "CC-BY-NC-4.0", "g": None, "h": "CC-BY-4.0", "i": "MIT", "j": "CC-BY-4.0", "k": "MIT", "l": "GPL-3.0"}
    assert licenses.scan(df, t).count() == len(rows) + 2
    own = {r.key: (r.licence, r.cosine) for r in licenses.own_licences(df.select("key", "text").dropDuplicates(["key"]), t).collect()}
    want = plain_licences([(k, x) for k, _, x in rows], licenses.TEMPLATES)
    assert own.keys() == want.keys() and all(own[k][0] == want[k][0] and abs(own[k][1] - want[k][1]) < 1e-5 for k in own)
    assert licenses.scan(spark.createDataFrame([], "key string, path string, text string"), t).count() == 0


def test_lookup_of_hot_keys(spark):
    left = spark.createDataFrame([(k, 1 if k % 3 else k) for k in range(3000)], "a long, k long")
    right = left.groupBy("k").agg(F.count("*").alias("c"), F.min("a").alias("least"))
    want = {(r.a, r.k): r.least for r in left.join(right, "k").collect()}
    for rows in (100_000, 5):
        assert {(r.a, r.k): r.least for r in common.lookup(left, right, ["k"], "c", rows).collect()} == want


def test_many_near_copies_that_dont_link(spark, monkeypatch):
    """Long texts that share two thirds of their shingles: the second round sends links, not all pairs."""
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(1700)]

    def changed(words, n):
        words = list(words)
        for k in rnd.sample(range(len(words)), n):
            words[k] = f"x{rnd.randrange(10**9)}"
        return words

    own = [changed(base, 40) for _ in range(24)]
    rows = [(k, " ".join(w), "", "", 0) for k, w in enumerate(own)] + [(100 + k, " ".join(changed(own[k], 8)), "", "", 0) for k in range(0, 24, 5)]
    df, sent = spark.createDataFrame(rows, DOCS), []
    # nothing is found in the first round
    monkeypatch.setattr(jaccard, "first_pairs", lambda nodes: spark.createDataFrame([], "a long, b long"))
    links = jaccard.tree_links
    monkeypatch.setattr(jaccard, "tree_links", lambda members, d: sent.append(links(members, d)) or sent[0])
    assert {r.id: (r.n, r.component) for r in jaccard.classes(df).collect()} == brute_components(rows)
    assert sorted((r.a, r.b) for r in sent[0].collect()) == [(k, 100 + k) for k in range(0, 24, 5)]
