"""Alignment chain on hand-written rows."""

from pyspark.sql import functions as F

from spanweave.operators import alignment as AL
from spanweave.operators import tagging as TG


def test_span_to_tokens_and_labels(spark):
    df = spark.createDataFrame(
        [(1, "Tokyo is big  now", [("location", 0, 5), ("work", 9, 12), ("person", 12, 13)])],
        "doc_id long, text string, ents array<struct<type:string,s:int,e:int>>")
    al = df.select(AL.span_to_tokens(df, "ents").alias("a")).first()[0]
    # the span starting on the double space separator is skipped
    assert [(r["type"], r["first_tok"], r["last_tok"]) for r in al] == [("location", 0, 0), ("work", 2, 2)]
    rows = AL.token_label_rows(df, "ents", {"location": 0, "work": 1}).first()
    assert rows["tokens"] == ["[CLS]", "Tokyo", "is", "big", "", "now", "[SEP]"]
    assert rows["labels"] == [-100, 1, 0, 3, 0, 0, -100]


def test_argmax_mask_and_ids(spark):
    df = spark.createDataFrame([([-100, 1, 0, -100], [[0.0, 0.1, 0.0], [0.2, 0.9, 0.9], [3.0, 0.0, 1.0],
                                                        [0.0, 0.0, 0.0]])], "labels array<int>, scores array<array<double>>")
    out = TG.mask_ignored(df.withColumn("preds", AL.argmax_labels(F.col("scores"))), "labels", "preds").first()
    assert out["labels"] == [1, 0] and out["preds"] == [1, 0]
    vocab = spark.createDataFrame([(0, "O")], "label_id int, label string")
    got = TG.ids_to_labels(df.withColumn("ids", F.array(F.lit(0), F.lit(7))), vocab, "ids").first()
    assert got["labels"] == ["O", "UNK-7"] and got["ids"] == [0, 7]
