"""Run document files and the report job: S5, S6, S7, J9, A17, B11."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanweave.catalog import register
from spanweave.operators import runs as RN
from spanweave.plans.report import full_report as report
from spanweave.queries.runs_q import _OK_KEYS, _RES
from spanweave.session import scratch_path
from spanweave.sources import results as RF
from spanweave.sources import runs as RS


def _written(spark, sf, runs=None):
    path = scratch_path(spark, f"results-{uuid.uuid4().hex}")
    r = RS.results(spark, sf)
    if runs is not None:
        r = r.where(F.col("model_key").isin(runs))
    RF.write_results(r, path)
    return path


@register("write_results", _RES + "SELECT model_key, status, round(f1, 6) AS f1 FROM res")
def write_results(spark, sf):
    p = _written(spark, sf)
    back = spark.read.option("multiLine", True).json(f"{p}/*")
    return back.select("model_key", "status", F.round("metrics.f1", 6).alias("f1"))


@register("read_results", _RES + "SELECT model_key, status, round(f1, 6) AS f1 FROM res")
def read_results(spark, sf):
    p = _written(spark, sf)
    # an unreadable document next to the good ones is skipped
    spark.createDataFrame([("{not json",)], "value string").write.text(f"{p}/run=broken")
    r = RF.read_results(spark, p)
    return r.select("model_key", "status", F.round("metrics.f1", 6).alias("f1"))


@register("merge_run_sets", _RES + "SELECT model_key, status, round(recall, 6) AS recall FROM res")
def merge_run_sets(spark, sf):
    keys = [k for k, *_ in RS.RUNS]
    a, b = _written(spark, sf, keys[:5]), _written(spark, sf, keys[5:])
    missing = scratch_path(spark, f"absent-{uuid.uuid4().hex}")
    return RF.merge_run_sets(spark, [a, b, missing]).select("model_key", "status", F.round("metrics.recall", 6).alias("recall"))


@register("comparison_table", _RES + """
SELECT CAST(row_number() OVER (ORDER BY f1 DESC, run_order) - 1 AS BIGINT) AS place, model_key AS "Model", model_name AS "Model Full Name",
       round(f1, 6) AS "F1", round(precision, 6) AS "Precision", round(recall, 6) AS "Recall", round(accuracy, 6) AS "Accuracy",
       training_time AS "Training Time (s)", n_train AS "Training Samples", n_test AS "Test Samples" FROM ok""")
def comparison_table(spark, sf):
    """The written file, read back: its rows are in order."""
    path = scratch_path(spark, f"comparison-{uuid.uuid4().hex}")
    r = RS.results(spark, sf)
    RF.export_comparison(r, path)
    back = spark.read.option("header", True).schema(RF.comparison_table(r).schema).csv(path)
    place = F.monotonically_increasing_id().alias("place")   # one file, one task
    return back.select(place, "Model", "Model Full Name", *[F.round(x, 6).alias(x) for x in ("F1", "Precision", "Recall", "Accuracy")],
                       "Training Time (s)", "Training Samples", "Test Samples")


@register("export_summary", _RES + """
SELECT model_key, display_name, round(f1, 6) AS f1, training_time, n_train AS num_train_samples, n_test AS num_test_samples FROM fl WHERE status = 'success'""")
def export_summary(spark, sf):
    path = scratch_path(spark, f"summary-{uuid.uuid4().hex}")
    summary = RN.summary_table(RN.successful_runs(RS.results(spark, sf)))
    RF.export_summary(summary, path)
    back = spark.read.option("header", True).schema(summary.schema).csv(f"{path}/csv")
    return back.select("model_key", "display_name", F.round("f1", 6).alias("f1"), "training_time", "num_train_samples", "num_test_samples")


@register("stage_time_total", _RES + "SELECT model_key, training_time AS total_time FROM res")
def stage_time_total(spark, sf):
    r = RS.results(spark, sf)
    stages = r.select("model_key", F.explode(F.array(
        F.struct(F.lit(1).alias("stage"), (F.col("training_time") * 0.25).alias("stage_time")),
        F.struct(F.lit(2).alias("stage"), (F.col("training_time") * 0.75).alias("stage_time")),
        F.struct(F.lit(3).alias("stage"), F.lit(None).cast("double").alias("stage_time")))).alias("s")).select("model_key", "s.*")
    return RN.stage_time_total(stages)


def _num(c: str) -> str:
    return f"printf('%.6f', round({c}, 6))"


def _digest(name: str, source: str, row: list[str], order: str) -> str:
    return (f"SELECT '{name}' AS \"table\", count(*) AS rows, md5(string_agg(concat_ws('|', {', '.join(row)}), chr(10) ORDER BY {order})) AS content FROM {source}")


_M3 = [_num(m) for m in ("precision", "recall", "f1")]
_REPORT = [
    _digest("summary", "(SELECT * FROM fl WHERE status = 'success')",
            ["model_key", "display_name", "model_name", "model_type", "CAST(use_crf AS VARCHAR)", "CAST(is_large AS VARCHAR)", "family", *_M3,
             _num("training_time"), "CAST(n_train AS VARCHAR)", "CAST(n_test AS VARCHAR)"], "f1 DESC, run_order"),
    _digest("comparison", "ok", ["model_key", "model_name", *[_num(m) for m in ("f1", "precision", "recall", "accuracy", "training_time")],
                                 "CAST(n_train AS VARCHAR)", "CAST(n_test AS VARCHAR)"], "f1 DESC, model_key"),
    *[_digest(f"ranking_{m}", f"(SELECT *, row_number() OVER (ORDER BY {m} DESC, run_order) AS rank FROM ok)",
              ["CAST(rank AS VARCHAR)", "model_key", _num(m)], "rank") for m in ("f1", "precision", "recall")],
    _digest("time_ranking", "(SELECT *, row_number() OVER (ORDER BY training_time, run_order) AS rank FROM ok)",
            ["CAST(rank AS VARCHAR)", "model_key", _num("training_time")], "rank"),
    _digest("radar", "(SELECT type, " + ", ".join(f"coalesce(max(f1) FILTER (WHERE model_key = '{k}'), 0.0) AS \"{k}\"" for k in _OK_KEYS)
            + " FROM rt GROUP BY type)", ["type", *[_num(f'"{k}"') for k in _OK_KEYS]], "type"),
    _digest("best_per_type", "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY f1 DESC, run_order) AS rk FROM rt) WHERE rk = 1)",
            ["type", "model_key", _num("f1")], "type"),
    _digest("pr_points", "rt", ["type", "model_key", *_M3], "type, model_key"),
]


@register("full_report", _RES + "\nUNION ALL ".join(_REPORT))
def full_report(spark, sf):
    path = scratch_path(spark, f"report-{uuid.uuid4().hex}")
    return report(RS.results(spark, sf), path, _OK_KEYS).select("table", "rows", "content")


@register("final_stage_metrics", _RES + """,
ag AS (SELECT model_key, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
              sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
              sum(f1 * support) / sum(support) AS wf FROM rt GROUP BY model_key),
fin AS (
  SELECT r.model_key, r.run_order, r.precision, r.recall, r.f1, r.accuracy, a.mp, a.mr, a.mf, a.wp, a.wr, a.wf FROM res r
  LEFT JOIN ag a USING (model_key))
SELECT model_key,
  round(CASE WHEN mp IS NULL THEN precision WHEN run_order % 2 = 0 THEN wp ELSE mp END, 6) AS precision,
  round(CASE WHEN mp IS NULL THEN recall WHEN run_order % 2 = 0 THEN wr ELSE mr END, 6) AS recall,
  round(CASE WHEN mp IS NULL THEN f1 WHEN run_order % 2 = 0 THEN wf ELSE mf END, 6) AS f1,
  round(accuracy, 6) AS accuracy, CASE WHEN mp IS NULL THEN 'eval' ELSE 'stage' END AS source
FROM fin""")
def final_stage_metrics(spark, sf):
    r = RS.results(spark, sf)
    pt = RN.per_type(RN.successful_runs(r))
    macro = pt.groupBy("model_key").agg(
        F.struct(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
        .alias("report"))
    weighted = pt.groupBy("model_key").agg(F.struct(
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in ("precision", "recall", "f1")])
        .alias("report"))
    even = r.where(F.col("run_order") % 2 == 0).select("model_key")
    stages = (macro.withColumn("stage", F.lit(1))
                   .unionByName(weighted.join(even, "model_key", "left_semi").withColumn("stage", F.lit(2))))
    out = RN.final_stage_metrics(r, stages)
    return out.select("model_key", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")],
                      F.round("accuracy", 6).alias("accuracy"), "source")
