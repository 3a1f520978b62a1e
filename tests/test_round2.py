"""Readers, states, retries and linear cost: what single queries don't show."""

import json
import time

import pytest
from pyspark.sql import functions as F

from spanweave.operators import corpus, fewshot, inference, planning, scoring, tagging
from spanweave.plans.evaluate import evaluate_llm
from spanweave.sources import results as R
from spanweave.sources.corpus import read_corpus_lines


def spans(n, name_s="s", name_e="e"):
    return F.expr(f"transform(sequence(0, {n} - 1), i -> named_struct('type', 'a', '{name_s}', i * 10, '{name_e}', i * 10 + 5))")


def cost(spark, build):
    out = {}
    for n in (1000, 8000):
        df = spark.range(1).select(F.col("id").alias("doc_id"))
        build(df, n).write.format("noop").mode("overwrite").save()
        t0 = time.perf_counter()
        build(df, n).write.format("noop").mode("overwrite").save()
        out[n] = time.perf_counter() - t0
    return out[8000] / max(out[1000], 0.15)


def test_long_rows_cost_in_proportion(spark):
    assert cost(spark, lambda d, n: scoring.match_arrays(d.select("doc_id", spans(n).alias("gold"), spans(n).alias("pred")))) < 12
    assert cost(spark, lambda d, n: d.select(spans(n, "start", "end").alias("ents"), F.lit(n * 10).alias("n"))
                .select(tagging.bio_tags_expr("ents", "n"))) < 12
    assert cost(spark, lambda d, n: d.select(corpus_column(n).alias("text")).select(corpus.chunk_expr("text", 20))) < 12


def corpus_column(n):
    return F.repeat(F.lit("some words end. "), n)


def test_overlapping_and_apart_tags_agree(spark):
    rows = [([("a", 0, 3), ("b", 5, 8)], 10), ([("a", 0, 6), ("b", 4, 8)], 10), ([("b", 4, 8), ("a", 0, 6)], 10), ([("a", -2, 3)], 5), ([], 3),
            ([("a", 2, 2), ("b", 1, 9)], 4)]
    df = spark.createDataFrame(rows, "ents array<struct<type:string,start:int,end:int>>, n int")
    for (ents, n), (got,) in zip(rows, df.select(tagging.bio_tags_expr("ents", "n")).collect()):
        want = ["O"] * n
        for t, s, e in ents:
            for i in range(max(s, 0), min(e, n)):
                want[i] = ("B-" if i == s else "I-") + t
        assert got == want


def test_corpus_formats(spark, tmp_path):
    (tmp_path / "plain.txt").write_text("{ a brace\n　\n second \nsecond\n", encoding="utf-8")
    got = read_corpus_lines(spark, str(tmp_path / "plain.txt")).collect()
    assert sorted(r.text for r in got) == ["second", "second", "{ a brace"] and len({r.line_id for r in got}) == 3
    (tmp_path / "j.jsonl").write_text('\n{"aug": " x "}\n{"other": 1}\nnot json\n{"aug": "　"}\n', encoding="utf-8")
    assert [r.text for r in read_corpus_lines(spark, str(tmp_path / "j.jsonl")).collect()] == ["x"]


def test_run_documents(spark, tmp_path):
    for run, body in {"a": json.dumps({"model_key": "m", "status": "success", "metrics": {"f1": 0.5}}, indent=2),
                      "b": json.dumps({"status": "failed"}), "c": "{broken"}.items():
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "result.json").write_text(body)
    df = R.read_results(spark, str(tmp_path / "runs" / "*" / "result.json"))
    assert df.count() == 2 and {(r.model_key, r.status) for r in df.collect()} == {("m", "success"), ("b", "failed")}
    assert R.merge_run_sets(spark, [str(tmp_path / "none"), str(tmp_path / "runs")]).count() == 2
    with pytest.raises(FileNotFoundError):
        R.merge_run_sets(spark, [str(tmp_path / "none")])


class Counting(inference.StubExtractionClient):
    def __init__(self, path):
        super().__init__(fail_first=False)
        self.path = path

    def __call__(self, prompt, attempt):
        import uuid
        with open(f"{self.path}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        return super().__call__(prompt, attempt)


def test_one_call_per_sample(spark, tmp_path):
    path = str(tmp_path)
    rows = [(i, f"Alpha beta Gamma{i} x", [("person", 0, 5)]) for i in range(7)]
    s = spark.createDataFrame(rows, "sample_id long, text string, gold array<struct<type:string,s:int,e:int>>")
    out = evaluate_llm(s, ["person", "work"], lambda: Counting(path))
    assert out.collect()[0].samples == 7 and out.count() == 1
    assert len(list(tmp_path.iterdir())) == 7


def test_no_retries_still_calls_once(spark):
    t = spark.createDataFrame([(1, "\nText: Alpha\nAnswer:")], "task_id long, prompt string")
    assert inference.run_inference(t, inference.StubExtractionClient, max_retries=0).count() == 1


def test_nameless_types_take_their_turn(spark):
    names = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "type string, rank int, name string")
    types = spark.createDataFrame([("a",), ("b",), ("c",)], "type string")
    got = planning.tasks_uniform_multi(spark, names, 6, entities_per_sample=1, types=types).collect()
    assert sorted((r.task_id, r.type) for r in got) == [(0, "a"), (1, "b"), (3, "a"), (4, "b")]


def test_diverse_selection_limits_groups_before_the_exchange(spark):
    rows = [(i, [("a", "n", [0, 1])] if i % 2 else [("a,b", "n", [0, 1])]) for i in range(50)]
    s = spark.createDataFrame(rows, "sample_id long, entities array<struct<type:string,name:string,span:array<int>>>")
    d = fewshot.few_shot_diverse(s, 4)
    assert "WindowGroupLimit" in d._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r.type_set) for r in d.collect()} == {("a",), ("a,b",)}
