import itertools
import zlib

import numpy as np

from spanweave.llm import line_crf as L

SF = "/root/testdata/sf0.01"


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    begin = np.array([0, 3, 4, 8])
    e, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs, z = L.Chains(begin).marginals(e, trans)
    want, want_pairs = np.zeros(8), np.zeros((2, 2))
    for a, b in zip(begin[:-1], begin[1:]):
        paths = {y: np.exp(sum(e[a + i] * s for i, s in enumerate(y)) + sum(trans[s, r] for s, r in zip(y, y[1:])))
                 for y in itertools.product((0, 1), repeat=b - a)}
        total = sum(paths.values())
        for y, p in paths.items():
            want[a:b] += np.array(y) * p / total
            for s, r in zip(y, y[1:]):
                want_pairs[s, r] += p / total
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs)


def test_neighbours_stay_in_their_text():
    x, size, begin = L.line_features(["AA|\nbb", "CC", ""])
    assert begin.tolist() == [0, 2, 3, 4] and size.tolist() == [3, 2, 2, 0]
    one = L.line_features(["CC"])[0]
    assert np.allclose(x[2], one[0])


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in L.op4_line_crf(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    test = [r for r in labels if rows[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in test]) > 0.95
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (2, "", 0.0), (None, "a\n" * 30_000, 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    m = L.train(docs, none)
    assert sorted((r.doc_id or 0, r.score) for r in L.quality_scores(docs, m).collect()) == [(0, .5), (1, .5), (2, .5), (2, .5)]
    labels = spark.createDataFrame([(1, 0), (2, 1), (1, None), (3, 1), (4, 0)], "doc_id long, quality int")
    texts = spark.createDataFrame([(1, "A|"), (2, None), (3, "some words"), (4, "B|"), (None, "x\n" * 30_000)], "doc_id long, text string")
    m = L.train(texts, labels)
    assert all(0 <= r.score <= 1 for r in L.quality_scores(texts, m).collect())
    assert L.quality_scores(texts.limit(0), m).count() == 0
