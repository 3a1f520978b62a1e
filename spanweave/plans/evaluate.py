"""B10 evaluate_llm: texts + gold -> prompts -> model -> parse -> tags ->
spans -> scores, as one Spark job (the model call is the only Python stage)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions.prompts import extraction_prompt
from spanweave.operators import inference as INF
from spanweave.operators import parsing as P
from spanweave.operators import scoring as SC
from spanweave.operators import tagging as TG
from spanweave.session import scratch_path


def evaluate_llm(samples: DataFrame, types: list[str], client_factory, model: str = "stub",
                 examples=None) -> DataFrame:
    """One RESULT-like row: micro precision / recall / F1, token accuracy,
    samples scored and calls made.  ``samples``: ``sample_id, text, gold``
    with gold as array<struct<type, s, e>>."""
    prompts = samples.select(F.col("sample_id").alias("task_id"),
                             extraction_prompt(F.col("text"), types, examples).alias("prompt"))
    # the call is expensive and not repeatable: every later use reads the stored replies
    path = scratch_path(samples.sparkSession, f"evaluate-{uuid.uuid4().hex}")
    INF.run_inference(prompts, client_factory).write.parquet(path)
    resp = samples.sparkSession.read.parquet(path)
    j = samples.join(resp.withColumnRenamed("task_id", "sample_id"), "sample_id", "left")
    parsed = P.parse_entities(j.fillna({"body": "[]"}), "body", "text", types, out_col="pents")
    ents = "transform(pents, x -> named_struct('type', x.type, 'start', CAST(x.start AS INT), 'end', CAST(x.end AS INT)))"
    gold = "transform(gold, x -> named_struct('type', x.type, 'start', CAST(x.s AS INT), 'end', CAST(x.e AS INT)))"
    t = parsed.select("sample_id", "ok", "input_tokens", "output_tokens",
                      TG.bio_tags_expr(gold, "length(text)").alias("gold_tags"),
                      TG.bio_tags_expr(ents, "length(text)").alias("pred_tags"))
    s = t.select("*", TG.bio_to_spans_expr("gold_tags").alias("gold"), TG.bio_to_spans_expr("pred_tags").alias("pred"))
    overall = SC.prf_overall(SC.match_arrays(s, sample_col="sample_id")).where(F.col("avg_type") == "micro avg")
    acc = TG.token_accuracy(s, "gold_tags", "pred_tags").select("accuracy")
    usage = s.agg(F.count(F.lit(1)).alias("samples"), F.count_if("ok").alias("calls"),
                  F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return (overall.crossJoin(acc).crossJoin(usage)
                   .select(F.lit(model).alias("model"), "precision", "recall", "f1", "accuracy", "samples",
                           "calls", "input_tokens", "output_tokens"))
