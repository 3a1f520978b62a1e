"""Spans are dealt out once as bare rows before their types are collected."""

from spanweave.operators import scoring

SPANS = "doc_id long, type string, s long, e long"


def test_type_confusion_makes_no_sets_below_the_exchange(spark):
    gold = spark.createDataFrame([(1, "a", 0, 3), (1, "a", 0, 3), (1, "b", 0, 3), (1, None, 0, 3), (2, None, 5, 9), (None, "a", 0, 3), (3, "a", 0, 1)], SPANS)
    pred = spark.createDataFrame([(1, "b", 0, 3), (1, "c", 0, 3), (2, None, 5, 9), (None, "b", 0, 3), (3, "a", 0, 2), (3, "a", 0, 2)], SPANS)
    out = scoring.type_confusion(gold, pred)
    got = sorted(tuple(r) for r in out.collect())
    assert got == [("NONE", "NONE", 1), ("NONE", "a", 1), ("a", "NONE", 1), ("a", "b", 2), ("a", "c", 1), ("b", "b", 1), ("b", "c", 1)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    sets, below = plan.index("partial_collect_set"), plan.index("RepartitionByExpression" if "RepartitionByExpression" in plan else "REPARTITION_BY_COL")
    assert sets < below and "collect_set" not in plan[below:]
