import random
from collections import Counter

import duckdb
import numpy as np

from spanweave.llm import dart_minhash as D
from spanweave.llm.wording import weighted_cells


def plain_words(t):
    return "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()


def grams(t):
    w = plain_words(t)
    return Counter([tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))] if w else [])


def brute(rows):
    """Smallest id of each component of exact weighted similarity 0.8."""
    g = {d: grams(t) for d, t in rows}
    by = {}
    for d, c in g.items():
        for s in c:
            by.setdefault(s, []).append(d)
    root = {d: d for d in g}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {(a, b) for ds in by.values() for a in ds for b in ds if a < b}
    for a, b in pairs:
        common = sum((g[a] & g[b]).values())
        if common >= 0.8 * (sum(g[a].values()) + sum(g[b].values()) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in g}


def test_signatures_estimate_the_similarity():
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    errors = []
    for cut in (0, 20, 60, 120, 250):
        other = base[cut:] + [f"x{rng.randrange(10**6)}" for _ in range(cut)]
        texts = [" ".join(base), " ".join(other)]
        cells, off = weighted_cells(texts)
        s = D.dart_signatures(cells, off, k=1024)
        a, b = grams(texts[0]), grams(texts[1])
        errors.append((s[0] == s[1]).mean() - sum((a & b).values()) / sum((a | b).values()))
    assert max(map(abs, errors)) < 0.06


def test_signature_does_not_depend_on_the_batch():
    texts = ["a b c d e f g", "x", "", "p q r s t u v w " * 30]
    cells, off = weighted_cells(texts)
    whole = D.dart_signatures(cells, off)
    for i, t in enumerate(texts):
        assert (D.dart_signatures(*weighted_cells([t]))[0] == whole[i]).all()
    assert not whole[2].any() and whole[3].all()


def test_table_against_brute_force(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    want = brute(rows)
    got = {r.doc_id: r for r in D.op3_dart_minhash(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in got.values())


def near_copies(n, seed=4):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(300)] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


def test_large_entries_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(D, "SMALL", 6)
    rows = near_copies(90) + [(1000 + i, t) for i, t in near_copies(40, 5)]
    got = {r.doc_id: r.component_id for r in D.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    t = "one two three four five six seven"
    rows = [(1, None, 0), (2, "", 0), (2, "", 0), (None, t, 0), (7, t.upper() + "!", 0), (7, t.upper() + "!", 0), (3, "a b", 0), (4, "A b.", 0),
            (9, "long text here " * 60_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted((r.doc_id or 0, r.component_id, r.kept, r.copies) for r in D.near_duplicates(df).collect())
    assert got == [(0, 7, False, 1), (1, 1, True, 1), (2, 2, True, 2), (3, 3, True, 1), (4, 3, False, 1), (7, 7, True, 2), (9, 9, True, 1)]
    kept = D.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 7, 9]
    assert D.near_duplicates(df.limit(0)).count() == 0 and D.keep_one(df.limit(0)).count() == 0
