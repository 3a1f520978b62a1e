import re
from collections import Counter

import numpy as np
import pytest

from spanweave.llm import source_divergence as S

SCHEMA = "doc_id long, text string, lang string, source string, value long, term string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, 7, "x") for i, r in enumerate(rows)], SCHEMA)


def brute(rows, min_docs, top=S.TOP):
    """The contract, by counting."""
    docs = [(l or "", s or "", [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")])
            for t, l, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for d in mine for w in set(d[2]))
        kept = {w for w, n in df.items() if n >= min_docs}
        counts = {s: Counter(w for d in mine if d[1] == s for w in d[2] if w in kept) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())

        def p(c, w):
            return 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))

        for s, c in counts.items():
            pairs = [(sum(abs(p(c, w) - p(o, w)) for w in kept), x) for x, o in counts.items() if x != s]
            terms = [(p(c, w) - p(whole, w), w) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, x, v, i + 1) for i, (v, x) in enumerate(found[:limit])]
    return sorted(out)


ROWS = [(" ".join(f"W{(i * j) % 7}{'abcde'[j % 5]}é" if j % 3 else "the X" for j in range(i % 9)), "en" if i % 4 else None, f"s{i % 5}" if i % 6 else None)
        for i in range(60)] + [(None, "fr", "a"), ("", "fr", "b"), ("漢字 漢字", "fr", "b"), ("the", "de", "only")] * 2 + [("z " * 3000, "en", "s1")]


@pytest.mark.parametrize("slices", [None, 3])
def test_equals_counting(spark, slices):
    got = S.divergence(frame(spark, ROWS), min_docs=3, top=4, slices=slices)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(ROWS, 3, 4)


def test_no_term_is_kept_and_empty_table(spark):
    rows = [("some words that stand in one document only " * 9, "en", "a"), ("others", "en", "b")]
    assert sorted(map(tuple, S.divergence(frame(spark, rows)).collect())) == brute(rows, 30)
    assert S.divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_blocks_add_up(spark):
    """Many blocks, sources without a term in some of them."""
    rows = [(" ".join("w" + "abcdefghij"[k % 10] + "x" * (k // 10) for k in range(i % 3, 1200, 1 + i % 3)), "en", f"s{i % 3}") for i in range(9)]
    assert sorted(map(tuple, S.divergence(frame(spark, rows), min_docs=2).collect())) == brute(rows, 2)


def test_shares_of_huge_counts_are_exact():
    for c, total, kept in ((10**12, 3 * 10**12, 10**7), (0, 10**13, 1), (7, 8, 3), (10**13, 10**13, 1)):
        assert S.share(np.array([c]), total, kept).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * kept)]


def test_slices_follow_the_size(spark):
    d = S.documents_of(frame(spark, [(" ".join("w" + "q" * k for k in range(40)), "en", "a")] * 40 + [("x", "en", "b")]))
    assert S.slices_needed(d, 3, 10**6) == 1
    assert S.slices_needed(d.limit(0), 3, 10) == 0
