import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spanweave.llm import token_alignment as T
from tests.conftest import SF


@pytest.fixture(scope="module")
def aligner():
    return T.Aligner(*T.default_tokenizers(), max_bytes=1 << 16)  # forgets often


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(T.default_tokenizers()[0])
    t.encode_special_tokens = True
    return t


def brute(text, plain, aligner):
    """Ids, groups and links of one text, token by token."""
    if not text:
        return [], [], [], []
    a, b = plain.encode(" " + text, add_special_tokens=False).ids, aligner.pieces.encode(text)
    char = T._byte_table()
    ab = [bytes(char[c] for c in plain.id_to_token(i)) for i in a]
    bb = [bytes([int(p[3:5], 16)]) if aligner.pieces.is_byte(i) else p.replace("▁", " ").encode()
          for i, p in ((i, aligner.pieces.id_to_piece(i)) for i in b)]
    if b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
        return [], [], [], []
    ea, eb = (np.cumsum([len(x) for x in y]).tolist() for y in (ab, bb))
    cuts = sorted(set(ea) & set(eb))
    links = [(a[ea.index(c)], b[eb.index(c)]) for c in cuts]
    groups, p = [], 0
    for c in cuts:
        groups.append(tuple(",".join(str(i) for i, e in zip(x, ends) if p < e <= c) for x, ends in ((a, ea), (b, eb))))
        p = c
    return a, b, links, groups


POOL = [*" .,  \n\n'\t", "▁", "<s>", *"abcdeABCDEİıéÉ019-!%ﬁ", "\u0301", "漢", "😀", "\u00a0", "<|endoftext|>", "hello", " the", "<unk>", "<0x0A>"]
TEXTS = [None, "", "a", "a  b", "a\nb\n\nc", "<s>hello </s>", "▁x", " lead", "trail ", "\n", "the quick brown fox, " * 400,
         "x" * 3000, *("".join(random.Random(i).choices(POOL, k=i % 15)) for i in range(400))]


def test_texts_equal_brute_force(aligner, plain):
    for i in range(0, len(TEXTS), 40):
        some = [t or "" for t in TEXTS[i:i + 40]]
        for t, (sizes, pairs, sha) in zip(some, aligner.texts(pa.array(some, pa.large_string()))):
            a, b, links, groups = brute(t, plain, aligner)
            assert sizes[:3].tolist() == [len(a), len(b), len(groups)], t
            assert [(int(p) // aligner.wide, int(p) % aligner.wide) for p in pairs] == links
            assert sha == (hashlib.sha256(";".join(f"{x}|{y}" for x, y in groups).encode()).hexdigest() if a else "")


def test_products_against_dense_matrices():
    rng = np.random.default_rng(1)
    for _ in range(50):
        size = int(rng.integers(1, 30))
        ends = [np.unique(np.append(rng.integers(1, size + 1, 6), size)) for _ in range(2)]
        a, b = (T.byte_incidence(e, size) for e in ends)
        dense = [np.array([[1 if (e[i - 1] if i else 0) <= k < e[i] else 0 for k in range(size)] for i in range(len(e))]) for e in ends]
        want = dense[0] @ dense[1].T
        got = np.zeros_like(want)
        for i, j, v in zip(*T.gustavson(a, b.transposed())):
            got[i, j] = v
        assert (got == want).all()
        m = T.multiply(np.zeros(len(ends[0]), int), np.zeros(len(ends[1]), int), np.diff(ends[0], prepend=0), np.diff(ends[1], prepend=0))
        assert sorted(zip(*map(np.ndarray.tolist, m.shared))) == [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if m.a_group[i] == m.b_group[j]]


def frame(spark, texts):
    return spark.createDataFrame([(i if i % 7 else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n long, links string")


def test_digests_over_a_table(spark, aligner, plain):
    texts = TEXTS[:120] + ["the same text"] * 5
    linked = T.linked_documents(frame(spark, texts).repartition(3))
    got = T.scored(linked, aligner.wide)
    want = [brute(t, plain, aligner) for t in texts]
    n = Counter(p for w in want for p in w[2])
    top = Counter()
    for (_, b), c in n.items():
        top[b] = max(top[b], c)
    rows = Counter((i if i % 7 else None, len(a), len(b), len(g), len(ls), sum(n[p] == top[p[1]] for p in ls), sum(n[p] for p in ls))
                   for i, (a, b, ls, g) in enumerate(want))
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) for r in got.collect()) == rows


def test_alignments_hold_the_whole_products(spark, aligner, plain):
    texts = ["hello wonderful tokenizers", None, "naïve 漢字", "a  b"]
    for r in T.alignments(frame(spark, texts)).collect():
        a, b, links, _ = brute(texts[r.doc_id or 0], plain, aligner)
        assert r.a_ids == a and r.b_ids == b and [(r.a_ids[x.a], r.b_ids[x.b]) for x in r.links] == links
        starts = [[0, *e[:-1]] for e in (r.a_ends, r.b_ends)]
        over = [(i, j, min(r.a_ends[i], r.b_ends[j]) - max(starts[0][i], starts[1][j])) for i in range(len(a)) for j in range(len(b))]
        assert [(x.a, x.b, x.bytes) for x in r.overlaps] == [o for o in over if o[2] > 0]


def test_pairs_stay_within_the_vocabularies_bound(spark, aligner):
    linked = T.linked_documents(spark.read.parquet(f"{SF}/documents.parquet"))
    assert T.pair_counts(linked).count() <= aligner.va.lens.sum() + aligner.vb.lens.sum()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert T.scored(T.linked_documents(empty), 32000).collect() == [] and T.alignments(empty).collect() == []
