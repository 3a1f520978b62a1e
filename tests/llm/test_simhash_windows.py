import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanweave.llm import simhash_windows as S


@pytest.mark.parametrize("width", S.WIDTHS)
def test_majority_counts_bits(spark, width):
    rng = random.Random(width)
    rows = [[rng.getrandbits(64) - (1 << 63) for _ in range(width)] for _ in range(20)]
    df = spark.createDataFrame([(r,) for r in rows], "h array<long>")
    got = [r[0] for r in df.select(S.majority([F.col("h")[i] for i in range(width)])).collect()]
    for r, g in zip(rows, got):
        want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in r) > width // 2)
        assert g & (1 << 64) - 1 == want


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def hits(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, k int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r["items"] for r in S.contamination(d, b).collect()}


def test_planted_items(spark):
    rng = random.Random(1)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([5, 9, 14, 28, 29, 60, 120, 4])]
    docs, want = [], {}
    for i, (item, text) in enumerate(items):
        for shift in range(16):  # every place of the grid
            d = len(docs)
            body = text.upper().replace(" ", ", ") if shift % 2 else text
            docs.append((d, " ".join(words(rng, 40 + shift)) + f" {body}. " + " ".join(words(rng, 30)), 0))
            want[d] = str(item) if i != 7 else ""
    clean = len(docs)
    docs += [(clean + i, " ".join(words(rng, 300)), 0) for i in range(20)]
    # one word changed in an item of 60 (5 of 56 shingles): similarity 0.91; eight changed: below 0.8
    w = items[5][1].split()
    w[30] = "changed"
    docs.append((1000, "x " * 11 + " ".join(w), 0))
    for j in range(2, 60, 7):
        w[j] = "other"
    docs.append((1001, "x " * 11 + " ".join(w), 0))
    want |= {clean + i: "" for i in range(20)} | {1000: "5", 1001: ""}
    assert hits(spark, docs, items) == want


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [(1, None, 0), (2, "", 0), (None, text, 0), (3, text, 0), (3, text, 0), (4, "w " * 60_000 + text, 0)]
    got = sorted((r.doc_id or 0, r.n_items) for r in S.contamination(
        spark.createDataFrame(docs, "doc_id long, text string, k int"),
        spark.createDataFrame([(7, text), (7, text), (8, None), (None, text), (9, "a b")], "item_id long, text string")).collect())
    assert got == [(0, 2), (1, 0), (2, 0), (3, 2), (3, 2), (4, 2)]
    assert set(hits(spark, docs, [(1, None)]).values()) == {""}


def similarity(region, item):
    """Share of the item's shingles that the region repeats."""
    def bag(w):
        return Counter(tuple(w[i:i + S.SHINGLE]) for i in range(len(w) - S.SHINGLE + 1))
    return sum((bag(region) & bag(item)).values()) / (len(item) - S.SHINGLE + 1)


def test_items_with_changed_words(spark):
    rng = random.Random(2)
    items, docs, want = [], [], {}
    for n in range(15, 60):
        item = words(rng, n)
        items.append((n, " ".join(item)))
        edits = [(at,) for at in range(n)] + [tuple(rng.sample(range(n), 2)) for _ in range(12)] + [(0, 1), (n - 2, n - 1), (n // 2, n // 2 + 1)]
        for e in edits:
            # a changed word, an additional one, one left out
            for new in (["changed"], None, []):
                body = [x for j, w in enumerate(item) for x in ([w] if j not in e else [w, "added"] if new is None else new)]
                d = len(docs)
                docs.append((d, " ".join(words(rng, 20 + d % 16) + body + words(rng, 20)), 0))
                want[d] = str(n) if similarity(body, item) >= S.SIMILARITY else ""
    assert sum(w != "" for w in want.values()) > 1000
    assert hits(spark, docs, items) == want
