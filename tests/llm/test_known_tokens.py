"""The table of tokens' features that op8 keeps: what it gives, and what stays when it is full."""

import re
import zlib

import numpy as np

from cuespan.llm import toxicity


def plain(token):
    w = token.lower().strip(toxicity.STRIP)
    h = lambda p, s: zlib.crc32(f"{p}{s}".encode()) & (toxicity.DIMS - 1)
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", token))[:8]
    return h("w", w), h("e", w[-3:]), h("s", shape), *(h(n, w[:n]) for n in toxicity.STEMS), h("p", w), h("n", w), token[-1] in ".!?"


def test_features_are_those_of_their_texts():
    for t in ["a", "A", "Ab", "aB", "Éa", "ǅa", "²a", "ⅷ", "日本", "İi", "fuß!", "x_y", "...", "12a", "Straßenbahn", "ABC-def?"]:
        assert toxicity._features(t) == plain(t)


def test_a_full_table_keeps_its_first_tokens(monkeypatch):
    monkeypatch.setattr(toxicity, "KNOWN", 4)
    known = toxicity._Known()
    for tokens in (["the", "of", "the"], ["the", "x1", "x2", "x3"], ["of", "y1", "y2", "y3", "y1"]):
        assert (known(tokens) == np.array([plain(t) for t in tokens])).all()
    assert set(known.places) == {"the", "of"} and len(known.rows) == 2
