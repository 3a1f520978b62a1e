import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spanweave.llm import noisy_toxicity as N

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    text = "idiot stupid moron loser pathetic the worthless book letter coffee " * 200
    return N.smoothed(N.trigram_counts([text]).reshape((N.N_CLASSES,) * 3).astype(float))


def cost(span, out, prices, model):
    t = N._class_table()
    c = [0, 0, *(0 if x == " " else int(t[ord(x)]) for x in out), 0]
    return sum(prices) - sum(float(model[c[i], c[i + 1], c[i + 2]]) for i in range(len(c) - 2))


@pytest.mark.parametrize("span", ["1d10t", "s.t.u", "booook", "l0o0s", "0", "a-$ $"])
def test_viterbi_against_all_paths(span, model):
    paths = {}
    for p in itertools.product(*(N._options(span, i) for i in range(len(span)))):
        out = "".join(c for c, _ in p)
        paths[out] = min(paths.get(out, 1e9), cost(span, out, [x for _, x in p], model))
    assert paths[N.decode(span, model)] == pytest.approx(min(paths.values()), abs=1e-4)


def test_paths_scored_at_once_equal_viterbi(model):
    spans = ["1d10t", "s.t.u", "booook", "l0o0s", "0", "hat3", "a$$", "@$$", "stuppid", "well-known", "stu-pid", "letter", "mm.ii", "x" * 9, "+1+1"]
    assert N.decode_all(spans, model) == [N.decode(x, model) for x in spans]
    assert N._paths("$" * 40) is None and N.decode_all(["$" * 40], model) == [N.decode("$" * 40, model)]


def test_restored_chunks(model):
    r = N.Restorer(model)
    assert r.restored(["what", "m0r0n", "Letter", "coffee!", "s.t.u.p.i.d", "looooser", "2024"]) == ["what", "moron", "letter", "coffee!", "stupid", "loser", "2024"]
    texts = ["what a m0r0n this i d i o t is", "letter coffee", "", "s.t.u.p.i.d looooser", "a s s x"]
    owner, got = r.evidence(pa.array(texts, pa.large_string()))
    plain = ["what a moron this idiot is", "letter coffee", "", "stupid loser", ""]
    for i, t in enumerate(plain[:4]):
        want = np.unique(N.chunk_evidence(t.split() or [""])[0])
        assert got[owner == i].tolist() == want.tolist()


@pytest.fixture(scope="module")
def toxic_model():
    words = "hate hater dude dumb ass asses foo fool stupid idiot the that here hat had and ate mass class all letter"
    return N.smoothed(N.trigram_counts([(words + " ") * 300]).reshape((N.N_CLASSES,) * 3).astype(float))


@pytest.mark.parametrize("shown,meant", [("hat3", "hate"), ("du3", "due"), ("a$$", "ass"), ("@$$", "ass"), ("f.o.o", "foo"), ("stuppid", "stupid"),
                                         ("1d1ot", "idiot"), ("stu-pid", "stupid"), ("stupid!!", "stupid!!"), ("class", "class"), ("3", "3"), ("hat", "hat")])
def test_disguised_words(toxic_model, shown, meant):
    assert N.Restorer(toxic_model).restored([shown]) == [meant]


def test_results_do_not_depend_on_what_is_kept(model):
    texts = pa.array(["m0r0n letter a s s", "booook s.t.u m0r0n", None, "x" * 2000 + " m0r0n"] * 3, pa.large_string()).fill_null("")
    one, two = N.Restorer(model), N.Restorer(model, max_bytes=0)
    for _ in range(2):
        a, b = one.evidence(texts), two.evidence(texts)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_long_chunk(model):
    assert set(N.decode("0" * 20_000, model)) <= {"o"}


def test_tail():
    assert np.isclose(np.exp(N._tail(2, 3, 0.1)), 3 * 0.01 * 0.9 + 0.001)


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in N.op9_noisy_toxicity(spark, SF).collect()}
    test = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())
    right = [rows[r.doc_id].predicted == r.toxic for r in test]
    assert np.mean(right) > 0.93 and len(rows) == 1000


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "st00pid " * 20_000)], "doc_id long, text string")
    m = N.character_model(docs)
    s = N.train(docs, spark.createDataFrame([(1, None)], "doc_id long, toxic int"), m)
    assert [r.score for r in N.toxicity_scores(docs, m, s).collect()] == [0.0] * 4
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0)], "doc_id long, toxic int")
    s = N.train(docs, labels, m)
    assert all(0 <= r.score <= 1 for r in N.toxicity_scores(docs, m, s).collect())
    assert N.toxicity_scores(docs.limit(0), m, s).count() == 0
    assert N.character_model(docs.limit(0)).shape == (N.N_CLASSES,) * 3
