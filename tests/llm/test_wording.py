from collections import Counter

import numpy as np

from spanweave.llm import wording as W

TEXTS = ["Des des DES x", "", "a b c d e f a b c d e", "été Été", "des", "!!! ..", "one two"]


def plain(t):
    out, w = [], ""
    for c in t.lower() + " ":
        if c.isalnum():
            w += c
        elif w:
            out.append(w)
            w = ""
    return out


def test_words_and_shingles():
    h, at = W.words(TEXTS)
    names = {}
    for i, t in enumerate(TEXTS):
        ws = plain(t)
        assert at[i + 1] - at[i] == len(ws)
        for w, x in zip(ws, h[at[i]:at[i + 1]].tolist()):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)
    s, off = W.shingles(TEXTS)
    sizes = [max(len(plain(t)) - 4, min(1, len(plain(t)))) for t in TEXTS]
    assert np.diff(off).tolist() == sizes
    c, off2 = W.weighted_cells(TEXTS)
    assert off2.tolist() == off.tolist() and len(set(c[off[2]:off[3]].tolist())) == 7


def test_cells_count_copies():
    a, b = "p q r s t " * 4, "p q r s t " * 2
    c, off = W.weighted_cells([a, b])
    x, y = set(c[off[0]:off[1]].tolist()), set(c[off[1]:off[2]].tolist())
    grams = [Counter(tuple(plain(t)[i:i + 5]) for i in range(len(plain(t)) - 4)) for t in (a, b)]
    assert len(x & y) == sum((grams[0] & grams[1]).values()) and len(x | y) == sum((grams[0] | grams[1]).values())
