import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanweave.llm import encoding as E
from spanweave.llm import repair_ids as R


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=200), st.integers(0, 220), st.integers(0, 60))
def test_round_trip(ids, start, length):
    x = np.array(ids, np.uint32)
    old = R.MIN_COUNT
    R.MIN_COUNT = 2
    try:
        g = R.compress(x, 4)
    finally:
        R.MIN_COUNT = old
    assert R.expand(g).tolist() == ids
    assert all(max(r) < 4 + i for i, r in enumerate(g.rules.tolist()))
    assert R.decode_range(g, start, length).tolist() == ids[start:start + length]


def test_repeats_shrink():
    x = np.tile(np.arange(64, dtype=np.uint32), 200)
    g = R.compress(x, 64)
    assert len(g.symbols) < len(x) / 40 and len(g.rules) == len(g.lengths)


TEXTS = ["", " a  b", "x\n\ny", "a \nb", "\n", " ", "don't it's I'LL be", "É Σ ΣΑΣ İx \tq", "<|endoftext|> a<|endoftext|>b",
         "á ́b", "x\n", "\nx", "a b   c", "e\x1ef", "漢字 かな 😀", "one, two.\nThree four"]


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunks_equal_whole_texts(name, spaced):
    import public_tokenizers
    path = public_tokenizers.path(name)
    enc = E.ChunkEncoder(path, spaced, max_bytes=1 << 14)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    for _ in range(2):
        ids, counts = enc.encode(pa.array(TEXTS, pa.large_string()))
        got = [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in TEXTS]


@pytest.mark.parametrize("name,spaced,ids", [("word_bpe_49k.json", False, [320, 49407, 321]), ("byte_bpe_50k.json", True, None)])
def test_operators_encode_added_tokens_as_the_library(name, spaced, ids):
    import public_tokenizers
    path = public_tokenizers.path(name)
    plain, enc = Tokenizer.from_file(path), E.encoder(path, spaced)
    texts = ["a <|endoftext|> b", *TEXTS, "A<|startoftext|>B\nc", "x <|ENDOFTEXT|> y", "<|endoftext|>", "a < |endoftext|>"]
    for _ in range(2):
        got, counts = enc.encode(pa.array(texts, pa.large_string()))
        got = [p.tolist() for p in np.split(got, np.cumsum(counts)[:-1])]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids is None or got[0] == ids


def test_table_against_library(spark):
    import public_tokenizers
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()
    want, start = {}, 0
    for d, t in docs:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in R.op1_repair_ids(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(2, "b", 1), (None, "a", 2), (2, "b", 3), (1, None, 4), (3, "x y " * 40_000, 5)],
                               "doc_id long, text string, part long")
    rows = R.read_ids(R.write_shards(df, shard_ids=8)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3]
    assert [r.start for r in rows] == [0, 2, 3, 5, 7] and rows[-1].n_tokens == 80_001
    assert R.read_ids(R.write_shards(df.limit(0))).count() == 0
