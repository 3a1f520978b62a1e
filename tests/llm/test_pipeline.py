import duckdb

import corpus_pipeline as C
from spanweave.llm import common, line_crf, line_templates, nnls_packing, simhash_windows
from tests.llm.test_dart_minhash import brute
from tests.llm.test_nnls_packing import check

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    frames = [docs.toPandas()]
    for name, stage in C.STAGES:
        out = common.stored(stage(spark, docs, SF), name)
        if name != "packing":
            assert out.columns == docs.columns
        frames.append(out.toPandas())
        docs = out
    d0, quality, lines, near, clean, packed = frames
    labels = duckdb.sql(f"select * from '{SF}/labels.parquet'").df().set_index("doc_id").quality
    # quality: the scores of the same model, one document at a time
    model = line_crf.train(common.table(spark, SF, "documents"), common.table(spark, SF, "labels"))
    want = {d for d, t in zip(d0.doc_id, d0.text) if model.scores([t])[0] >= line_crf.THRESHOLD}
    assert set(quality.doc_id) == want and len(quality) == len(want)
    good = set(labels[labels == 1].index)
    assert len(good & want) >= 0.99 * len(good) and len(want - good) < len(d0) - len(good)
    # lines: the operator's SQL over the stage's input
    con = duckdb.connect()
    con.register("documents", quality)
    kept = con.sql(line_templates.ORACLE_SQL).df()
    kept = kept[(kept.lines_dropped == 0) | (kept.text.str.strip(" ") != "")]
    assert dict(zip(lines.doc_id, lines.text)) == dict(zip(kept.doc_id, kept.text))
    assert (lines.n_chars == lines.text.str.len()).all()
    # near duplicates: one of each exact component
    root = brute(list(zip(lines.doc_id, lines.text)))
    assert sorted(near.doc_id) == sorted(set(root.values()))
    # decontamination: every shared shingle as a candidate
    con = duckdb.connect()
    con.register("documents", near)
    con.sql(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    bad = {r[0] for r in con.sql(f"with {simhash_windows.HITS_SQL} select distinct doc_id from hits").fetchall()}
    assert set(clean.doc_id) == set(near.doc_id) - bad and bad
    # packing
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(nnls_packing.default_tokenizer())
    t.encode_special_tokens = True
    ids = {d: [*t.encode(x, add_special_tokens=False).ids, 0] for d, x in zip(clean.doc_id, clean.text)}
    assert check(list(packed.itertuples()), ids, 1024) == 0


def test_odd_rows(spark):
    rows = [(1, None, "x", 0, 1), (2, "", "x", 0, 2), (2, "", "x", 0, 2), (None, "some words that stand here alone today", "y", 38, 3),
            (4, "a long line of words " * 10_000, "y", 210_000, 4)]
    schema = "doc_id long, text string, source string, n_chars long, copies int, drop int, k int, n int, score double, parts string"
    docs = spark.createDataFrame([(*r, 1, 1, 1, 0.5, "p") for r in rows], schema)
    for frame in (docs, docs.limit(0)):
        now = frame
        for name, stage in C.STAGES:
            now = common.stored(stage(spark, now, "/root/testdata/sf0.001"), name)
            if name != "packing":
                assert now.columns == docs.columns
                assert frame is docs or now.count() == 0
        if frame is docs:
            assert {r.doc_id for r in now.collect()} >= {None, 4}
