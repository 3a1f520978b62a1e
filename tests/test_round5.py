"""Keys of spans made once a document, matching without per-span structs."""

from pyspark.sql import functions as F

from spanweave.llm import source_divergence as sd
from spanweave.operators import scoring
from spanweave.sources import fixtures as fx
from spanweave.sources import runs as RS

SPANS = "array<struct<type:string,s:int,e:int>>"


def test_runs_make_the_keys_below_the_fan_out(spark, monkeypatch):
    a = fx.with_annotations(spark.createDataFrame([(7, "en", "Alpha, betas Gamma gam")], "doc_id long, lang string, text string"))
    monkeypatch.setattr(RS.fx, "annotated", lambda *_: a)
    runs = RS.run_type_counts(spark, "")
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Generate explode([[")]
    assert "lambda x" not in above and "split(" not in above
    assert {r["support"] for r in runs.groupBy("model_key").agg(F.sum("support").alias("support")).collect()} == {2}


def test_match_arrays_of_spans_and_of_their_keys(spark):
    rows = [(1, [("a", 0, 3), ("a", 0, 3), ("b:c", 4, 6), (None, 7, 9)], [("a", 0, 3), ("b:c", 4, 7), (None, 7, 9), ("", 1, 2)]), (2, None, [("a", 0, 1)]), (3, [], [])]
    df = spark.createDataFrame(rows, f"doc_id long, gold {SPANS}, pred {SPANS}")
    want = {(1, "a", 0, 3, "tp"), (1, None, 7, 9, "tp"), (1, "b:c", 4, 6, "fn"), (1, "b:c", 4, 7, "fp"), (1, "", 1, 2, "fp")}
    out = scoring.match_arrays(df)
    got = [tuple(r) for r in out.select("doc_id", "type", "s", "e", "outcome").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and dict(out.dtypes)["s"] == "int"
    keys = df.select("doc_id", *[F.expr(f"transform({c}, x -> {scoring.span_key('x')})").alias(c) for c in ("gold", "pred")])
    got = [tuple(r) for r in scoring.match_arrays(keys, keyed=True).select("doc_id", "type", "s", "e", "outcome").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_terms_are_marked_by_text_and_cut_once(spark, monkeypatch):
    langs = ["en", "a b", "$1\\", "", "é\u0001x"]
    rows = [(lang, "s", "Été's ROOM, no break\u0001B " * 2) for lang in langs] + [(None, None, None), ("en", "s", "1 2")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    out = sd.documents_of(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    terms = [[w.split(sd.MARK)[1] for w in r["words"]] for r in out.collect()]
    want = ["Été", "s", "room", "no break", "b"] * 2   # É isn't lowered
    assert terms == [want] * len(langs) + [[], []]

    written = []
    store = sd.stored
    monkeypatch.setattr(sd, "stored", lambda df, name, **k: (written.append(name), store(df, name, **k))[1])
    counts, words = sd.group_vectors(docs, min_docs=1, slices=2)
    assert written.count("divergence-terms") == 1
    got = {(r["lang"], r["word"], r["n"]) for r in counts.join(words.drop("lang"), "term").collect()}
    assert got == {(lang, w, 2) for lang in langs for w in want}
    assert {r["lang"] for r in words.collect()} == set(langs)
