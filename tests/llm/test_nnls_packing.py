import zlib
from collections import defaultdict

import duckdb
import numpy as np
from tokenizers import Tokenizer

from spanweave.llm import nnls_packing as K


def check(pieces, ids_of, window):
    """Every id of every document in exactly one piece; sequences gapless."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        seqs[p.sequence_id].append(p)
    assert set(docs) == set(ids_of)
    for d, ps in docs.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids_of[d]) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids_of[d][at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids_of[d])
    padding = 0
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def plain_ids(sf):
    t = Tokenizer.from_file(K.default_tokenizer())
    t.encode_special_tokens = True
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    return {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in rows}


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    assert check(K.op8_nnls_packing(spark, sf).collect(), plain_ids(sf), 1024) == 0


def test_nnls_on_a_known_system():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    x = K.nnls(a, np.array([3.0, 5.0]))
    assert (x >= 0).all() and np.allclose(a @ x, [3, 5], atol=1e-3)
    assert np.allclose(K.nnls(np.eye(2), np.array([-1.0, 2.0])), [0, 2], atol=1e-6)


def test_plan_stays_in_the_histogram():
    rng = np.random.default_rng(1)
    for _ in range(5):
        h = rng.poisson(3, 64)
        h[0] = 0
        used = np.zeros(64, int)
        for p, n in K.plan(h):
            assert sum(p) == 64
            for x in p:
                used[x] += n
        assert (used <= h).all() and used.sum() > 0.6 * h.sum()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "", 0), (None, "a b", 0), (3, "word " * 5000, 0)],
                               "doc_id long, text string, part int")
    rows = K.digests(K.pack(df)).collect()
    assert sum(r.length for r in rows if r.doc_id == 2) == 2 and sum(r.length for r in rows if r.doc_id == 1) == 1
    seqs = defaultdict(int)
    for r in rows:
        seqs[r.sequence_id] += r.length
    assert all(n == 1024 or n & (n - 1) == 0 for n in seqs.values())
    assert K.pack(df.limit(0)).count() == 0
