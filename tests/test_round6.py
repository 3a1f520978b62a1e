"""Candidates cut in Arrow batches: the same rows as the rule, without a call per character."""

import hashlib
import random

from spanweave.llm import source_divergence as sd
from spanweave.sources import fixtures as fx

TEXTS = [None, "", " ", "   ", "Abc", "Abcd", "Abcd.", "Abc.!|", "....", "a....", "éÀbcd Zürich, 東京タワー。 x😀yzw Ab😀d:", "Tabs\tand\nlines\r\n end ",
         "wwww Www.w ?;:, Wow!wow", " Lead trail: ", "Å" * 5, "Q" + "ö" * 4000, "Word " * 3000 + "last"]


def rule(doc, text):
    """Gold and pred of one document, token by token."""
    if text is None:
        return None, None
    cands, at = [], 0
    for tok in text.split(" "):
        name = tok.rstrip(fx.TRAILING_PUNCT)
        if len(name) >= fx.MIN_NAME_LEN:
            cands.append((fx.TYPE_BY_LENGTH[len(name) % 5], at, at + len(name), name))
        at += len(tok) + 1
    gold = [c for c in cands if "A" <= c[3][0] <= "Z"]
    if doc is None:
        return gold, []
    h = {c: hashlib.md5(f"pred:{doc}:{c[1]}".encode()).hexdigest() for c in cands}
    pred = [("person" if h[c][2] == "2" else c[0], c[1], c[2] - (h[c][1] == "1"), c[3]) for c in gold if h[c][0] != "0"]
    return gold, pred + [c for c in cands if c not in gold and h[c][0] == "f" and h[c][1] < "4"]


def test_annotations_equal_the_rule_token_by_token(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "SLICE_BYTES", 4000)
    rng = random.Random(6)
    texts = TEXTS + [" ".join("".join(rng.choice("aZwé.,|😀☆\t") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = [(i, "en", t) for i, t in enumerate(texts)] + [(None, "en", "Alpha betas " * 90), (3, None, "Abcd"), (3, None, "Abcd")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    for garbled in (False, True):
        marks = {ord("\n"): " ", ord("\t"): " ", ord("\r"): " ", **({ord("w"): "☆"} if garbled else {})}
        clean = [(d, lang, t if t is None else t.translate(marks)) for d, lang, t in rows]
        want = [(d, lang, t, *rule(d, t)) for d, lang, t in clean]
        out = fx.with_annotations(fx.docs(spark, str(tmp_path), garbled))
        got = [(r.doc_id, r.lang, r.text, *(x if x is None else [tuple(c) for c in x] for x in (r.gold, r.pred))) for r in out.collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_no_lambda_runs_per_character(spark):
    d = fx.with_annotations(spark.createDataFrame([(1, "en", "Alpha, betas Gamma gam")], "doc_id long, lang string, text string"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "sequence(" not in plan


def test_terms_are_stored_as_one_string_a_document(spark, monkeypatch):
    docs = spark.createDataFrame([("a b", "s", "Alpha, beta ALPHA"), ("", None, " Gamma"), (None, "s", None)], "lang string, source string, text string")
    kinds, store = {}, sd.stored
    monkeypatch.setattr(sd, "stored", lambda df, name, **k: (kinds.setdefault(name, dict(df.dtypes)), store(df, name, **k))[1])
    counts, words = sd.group_vectors(docs, min_docs=1, slices=2)
    assert "array<string>" not in kinds["divergence-terms"].values()
    got = {(r["lang"], r["source"], r["word"], r["n"]) for r in counts.join(words.drop("lang"), "term").collect()}
    assert got == {("a b", "s", "alpha", 2), ("a b", "s", "beta", 1), ("", "", "gamma", 1)}
