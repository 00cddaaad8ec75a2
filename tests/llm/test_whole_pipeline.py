"""All five stages of the pipeline, one after the other, against plain Python on the smallest tables."""

import hashlib
import re
from collections import Counter
from math import log2

import corpus_pipeline
from cuespan.llm import pii, quality_rules
from cuespan.llm.common import local_file
from test_llm import plain_spans

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def good(t):
    """The table of rules, as the pipeline has it."""
    w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
    n, chars = len(w), sum(map(len, w))
    three = [tuple(w[i : i + 3]) for i in range(n - 2)]
    often = Counter(three)
    repeated = len({j for i, x in enumerate(three) if often[x] > 1 for j in (i, i + 1, i + 2)})
    lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    kinds = set(lines)
    again, size = len(lines) - len(kinds), sum(map(len, lines))
    twice = size - sum(map(len, kinds))
    count = lambda cs: sum(c in cs for c in t or "")
    if n < 50 or 100 * repeated > 50 * n or 100 * count("#*$%&|<>") > 5 * chars or (again >= 2 and 100 * twice > 30 * size):
        return False
    different = len(set(w))
    if 100 * count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 50 * chars or (different**2 < 9 * n and 100 * different < 15 * n):
        return False
    return 2 * n <= chars <= 40 * n and 100 * sum(x in quality_rules.STOP_WORDS for x in w) <= 80 * n


def first_of_each_group(docs):
    sets = {}
    for i, t in docs.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", t.translate(LOWER)) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: t for i, t in docs.items() if find(i) == i}


def clean(docs, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    return {i: t for i, t in docs.items() if not hit(words(t))}


def without_personal_data(docs):
    word = re.compile(r"[^\W\d_][^\W_]{2,}")
    total, of_ent, n_t, own, base = len(docs), {}, Counter(), {}, {}
    for i, t in docs.items():
        n_t.update({m[0].lower() for m in word.finditer(t)})
        blank, base[i] = t, []
        for s in filter(None, plain_spans(t).split(",")):
            kind, a, b = s.split(":")
            a, b = int(a), int(b)
            v = t[a:b].lower() if kind == "email" else t[a:b] if kind == "ip" else re.sub("[^0-9]", "", t[a:b])
            of_ent.setdefault((kind, v), set()).add(i)
            base[i].append((a, [k for k, _, _ in pii.KINDS].index(kind), b, f"<{kind.upper()}>"))
            blank = blank[:a] + " " * (b - a) + blank[b:]
        own[i] = [(m[0].lower(), m.start(), m.end()) for m in word.finditer(blank)]
    stems = Counter()
    for w, n in n_t.items():
        for k in pii.LADDER:
            if len(w) > k:
                stems[w[:k]] += n
    pmi = lambda both, e, t: log2((both + pii.SMOOTH * e / total) / (t + pii.SMOOTH) * total / e)
    told = {}
    for docs_of in of_ent.values():
        e = len(docs_of)
        ic = log2(total / e)
        for w, n in Counter(w for i in docs_of for w in {x for x, _, _ in own[i]}).items():
            if ic > 0 and pmi(n, e, n_t[w]) >= pii.GENERALISE * ic:
                gone = n >= pii.EVIDENCE and pmi(n, e, n_t[w]) >= pii.REMOVE * ic
                general = next((w[:k] for k in pii.LADDER if len(w) > k and pmi(e, e, stems[w[:k]]) < pii.GENERALISE * ic), "")
                for i in docs_of:
                    told.setdefault((i, w), []).append((gone, general))
    out = {}
    for i, t in docs.items():
        spans = list(base[i])
        for w, a, b in own[i]:
            if (i, w) in told:
                general = min(g for _, g in told[i, w])
                spans.append((a, len(pii.KINDS), b, "" if any(gone for gone, _ in told[i, w]) else f"{general}*" if general else "<TERM>"))
        at, done = 0, []
        for a, _, b, new in sorted(spans):
            if a >= at:
                done += [t[at:a], new]
                at = b
        out[i] = "".join(done) + t[at:]
    return out


def test_the_whole_result(spark):
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    steps = [{i: t for i, t in docs.items() if good(t)}]
    steps.append(first_of_each_group(steps[0]))
    steps.append(clean(steps[1], items))
    steps.append(without_personal_data(steps[2]))
    assert len(docs) > len(steps[0]) > len(steps[1]) > len(steps[2]) > 0 and steps[3] != steps[2]
    tokenizer = Tokenizer.from_file(local_file("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for i, t in steps[3].items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
