"""Invariants and edge rows for scoring, tagging, sampling and parsing."""

from pyspark.sql import functions as F

from spanweave.operators import parsing as P
from spanweave.operators import sampling as S
from spanweave.operators import scoring as SC
from spanweave.operators import tagging as TG

ENT = "array<struct<type:string,s:int,e:int>>"


def test_gold_vs_gold_scores_one(spark):
    df = spark.createDataFrame([(1, [("a", 0, 3), ("b", 4, 6)], [("a", 0, 3), ("b", 4, 6)])],
                               f"doc_id long, gold {ENT}, pred {ENT}")
    rows = {r["type"]: r for r in SC.prf_by_type(SC.match_arrays(df)).collect()}
    assert rows["a"]["f1"] == 1.0 and rows["b"]["precision"] == 1.0


def test_empty_report_is_zero(spark):
    df = spark.createDataFrame([(1, [], [])], f"doc_id long, gold {ENT}, pred {ENT}")
    assert SC.prf_by_type(SC.match_arrays(df)).count() == 0
    assert {r["f1"] for r in SC.prf_overall(SC.match_arrays(df)).collect()} == {0.0}


def test_bio_tags_overlap_and_roundtrip(spark):
    ents = "array<struct<type:string,start:int,end:int>>"
    df = spark.createDataFrame(
        [("abcdefghij", [("A", 0, 10), ("B", 5, 7)]),      # later entity overwrites
         ("𠮷野家 x", [("P", 0, 3)]),                        # surrogate pair counts once
         ("", [("A", 0, 1)]),                                # empty text
         ("abc", [("A", -2, 2), ("B", 2, 2)])],              # negative start, empty span
        f"text string, ents {ents}")
    tags = [r[0] for r in df.select(TG.bio_tags_expr("ents", "length(text)")).collect()]
    assert tags[0] == ["B-A", "I-A", "I-A", "I-A", "I-A", "B-B", "I-B", "I-A", "I-A", "I-A"]
    assert tags[1] == ["B-P", "I-P", "I-P", "O", "O"]
    assert tags[2] == []
    assert tags[3] == ["I-A", "I-A", "O"]
    t = spark.createDataFrame([(["I-A", "I-A", "O", "B-B", "I-B", "I-A", "B-A"],)], "tags array<string>")
    got = [(r["type"], r["s"], r["e"]) for r in t.select(TG.bio_to_spans_expr("tags")).first()[0]]
    assert got == [("A", 0, 2), ("B", 3, 5), ("A", 5, 6), ("A", 6, 7)]


def test_exact_split_sizes(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "sample_id")
    out = dict(S.exact_split(df, "sample_id", 42).groupBy("split").count().collect())
    assert out == {"train": 802, "validation": 100, "test": 101}
    k = S.first_k(df, "sample_id", 42, 7).count()
    assert k == 7


def test_parse_entities_edges(spark):
    text = "Tokyo and Osaka"
    replies = [
        '```json\n[{"type":"location","text":"Tokyo","span":[0,5]}]\n```',
        '回答: [{"type":"location","text":"Osaka","span":[10,15]}]',
        '[{"type":"location","text":"Tokyo","span":[0,5.0]}, "x", {"type":"zzz","text":"a","span":[0,1]},'
        ' {"type":"location","text":"a","span":[0,99]}]',
        'junk\n[{"type":"location","span":[0,5]}]\n[broken',
        "nothing here",
    ]
    df = spark.createDataFrame([(i, r, text) for i, r in enumerate(replies)], "id long, reply string, text string")
    got = {r["id"]: r["entities"] for r in P.parse_entities(df, "reply", "text", ["location"]).collect()}
    assert [(e["text"], e["start"], e["end"]) for e in got[0]] == [("Tokyo", 0, 5)]
    assert [(e["text"], e["start"]) for e in got[1]] == [("Osaka", 10)]
    assert got[2] == []
    assert [(e["start"], e["end"]) for e in got[3]] == [(0, 5)]
    assert got[4] == []


def test_repair_outcomes(spark):
    body = ('<start_annotation>{"text":"ab cd ab","entities":[{"type":"t","name":"cd","start":3,"end":5},'
            '{"type":"t","name":"ab","start":1,"end":3},{"type":"t","name":"zz","start":0,"end":2},'
            '{"type":"t","name":"","start":0,"end":0}]}</end_annotation>')
    df = spark.createDataFrame([(body,)], "reply string")
    ents = P.extract_annotation(df, "reply").first()["entities"]
    assert [(e["outcome"], e["start"]) for e in ents] == [("kept", 3), ("moved", 0), ("dropped", None),
                                                           ("empty_name", None)]
