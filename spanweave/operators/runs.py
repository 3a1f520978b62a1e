"""Leaderboards over run results: P8, J7, A11, A12, A13, A17, A20, W4, L3, L4,
L9, L10, F13, F16, U3.

Result tables hold one row per run; per-type metrics are a map column.  All
rankings carry a total order (metric, then input order) so ties are stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanweave.functions.models import model_family, run_flags

METRICS = ("precision", "recall", "f1")


def successful_runs(results: DataFrame, require: bool = False) -> DataFrame:
    """Runs with ``status = 'success'``; ``require`` raises when none."""
    ok = results.where(F.col("status") == "success")
    if require and not ok.select("model_key").take(1):
        raise ValueError("no successful runs")
    return ok


def metric(name: str) -> Column:
    """A run metric, missing = 0."""
    return F.coalesce(F.col(f"metrics.{name}"), F.lit(0.0))


def with_flags(results: DataFrame) -> DataFrame:
    hp_crf = F.get_json_object("hyperparameters", "$.use_crf") == "true"
    return (results.withColumn("flags", run_flags(F.col("model_key"), F.col("model_name"), hp_crf))
                   .withColumn("family", model_family(F.col("model_name"))))


def run_ranking(results: DataFrame, by: str = "f1") -> DataFrame:
    """Runs by a metric desc (missing = 0), rank from 1, input order on ties."""
    w = Window.orderBy(F.desc(metric(by)), "run_order")
    return results.withColumn("rank", F.row_number().over(w))


def best_worst_run(results: DataFrame, by: str = "f1") -> DataFrame:
    """The run with the max and the min metric; the first wins ties."""
    k = F.struct(metric(by).alias("v"), (-F.col("run_order")).alias("o"))
    kmin = F.struct(metric(by).alias("v"), F.col("run_order").alias("o"))
    return results.agg(F.max_by("model_key", k).alias("best"), F.min_by("model_key", kmin).alias("worst"))


def per_type(results: DataFrame) -> DataFrame:
    """Rows ``model_key, run_order, type, precision, recall, f1, support``."""
    e = results.select("model_key", "run_order", F.explode("metrics_per_type").alias("type", "m"))
    return e.select("model_key", "run_order", "type", F.col("m.precision").alias("precision"),
                    F.col("m.recall").alias("recall"), F.col("m.`f1-score`").alias("f1"),
                    F.col("m.support").alias("support"))


def type_leaderboard(results: DataFrame) -> DataFrame:
    """Per type, the runs that report it ordered by F1 desc."""
    w = Window.partitionBy("type").orderBy(F.desc("f1"), "run_order")
    return per_type(results).withColumn("rank", F.row_number().over(w))


def best_run_per_type(results: DataFrame) -> DataFrame:
    """The winner of each type (an aggregate, no window)."""
    p = per_type(results)
    k = F.struct(F.col("f1").alias("v"), (-F.col("run_order")).alias("o"))
    return p.groupBy("type").agg(F.max_by("model_key", k).alias("model_key"), F.max("f1").alias("f1"))


def top_bottom_types(results: DataFrame, model_key: str, k: int = 2, by: str = "f1") -> DataFrame:
    """L3: best and worst k types of one run by a metric (ties by type)."""
    p = per_type(results.where(F.col("model_key") == model_key))
    top = p.orderBy(F.desc(by), "type").limit(k).withColumn("which", F.lit("top"))
    bot = p.orderBy(F.asc(by), "type").limit(k).withColumn("which", F.lit("bottom"))
    return top.unionByName(bot)


def summary_table(results: DataFrame) -> DataFrame:
    """L4: runs by F1 desc with derived flags and sample counts."""
    f = with_flags(results)
    return (f.select("model_key", F.col("flags.display_name").alias("display_name"), "model_name",
                     F.col("flags.model_type").alias("model_type"), F.col("flags.use_crf").alias("use_crf"),
                     F.col("flags.is_large").alias("is_large"), "family",
                     *[metric(m).alias(m) for m in METRICS], "training_time",
                     F.col("num_samples.train").alias("num_train_samples"), F.col("num_samples.test").alias("num_test_samples"), "run_order")
             .orderBy(F.desc("f1"), "run_order"))


def crf_split_topk(results: DataFrame, k: int = 6) -> DataFrame:
    """Runs split by the CRF flag, top k of each by F1."""
    f = with_flags(results).withColumn("use_crf", F.col("flags.use_crf"))
    w = Window.partitionBy("use_crf").orderBy(F.desc(metric("f1")), "run_order")
    return f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def time_ranking(results: DataFrame) -> DataFrame:
    """Runs by training time ascending."""
    w = Window.orderBy(F.asc_nulls_last("training_time"), "run_order")
    return results.withColumn("rank", F.row_number().over(w))


def improvement_pct(this: Column, other: Column) -> Column:
    """(this - other) / other * 100, 0 when other <= 0."""
    return F.when(other > 0, (this - other) / other * 100).otherwise(F.lit(0.0))


def _only(results: DataFrame, key: str) -> DataFrame:
    """The run of a key; running it fails where several runs have the key."""
    row = F.struct(*results.columns)
    one = results.where(F.col("model_key") == key).agg(F.count(F.lit(1)).alias("n"), F.max_by(row, "run_order").alias("r")).where("n > 0")
    repeated = F.raise_error(F.concat(F.lit(f"several runs have the key {key}: "), F.col("n").cast("string")))
    return one.select(F.when(F.col("n") == 1, F.col("r")).otherwise(repeated.cast(results.select(row.alias("r")).schema["r"].dataType)).alias("r")).select("r.*")


def compare_runs(results: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Two runs side by side per metric: values, difference, improvement
    of a over b, plus the training time difference."""
    a, b = _only(results, key_a), _only(results, key_b)
    j = a.alias("a").crossJoin(b.alias("b"))  # one row on each side
    rows = []
    for m in METRICS:
        va, vb = F.coalesce(F.col(f"a.metrics.{m}"), F.lit(0.0)), F.coalesce(F.col(f"b.metrics.{m}"), F.lit(0.0))
        rows.append(F.struct(F.lit(m).alias("metric"), va.alias("value_a"), vb.alias("value_b"),
                             (va - vb).alias("diff"), improvement_pct(va, vb).alias("improvement_pct")))
    ta, tb = F.col("a.training_time"), F.col("b.training_time")
    rows.append(F.struct(F.lit("training_time").alias("metric"), ta.alias("value_a"), tb.alias("value_b"),
                         (ta - tb).alias("diff"), improvement_pct(ta, tb).alias("improvement_pct")))
    return j.select(F.inline(F.array(*rows)))


def radar_matrix(results: DataFrame, model_keys: list[str]) -> DataFrame:
    """F16: type x run F1 matrix, missing = 0 (pivot values passed in, so no
    extra job collects them)."""
    p = per_type(results)
    return p.groupBy("type").pivot("model_key", model_keys).agg(F.first("f1")).fillna(0.0)


def all_types(results: DataFrame) -> DataFrame:
    """Union of type names over runs, sorted."""
    return (results.select(F.explode(F.map_keys("metrics_per_type")).alias("type"))
                   .distinct().orderBy("type"))


def final_stage_metrics(results: DataFrame, stages: DataFrame) -> DataFrame:
    """Micro P/R/F1 of the last stage when that stage has a report, else
    the evaluation metrics; accuracy always from the evaluation.  ``stages``:
    ``model_key, stage, report struct<precision, recall, f1>`` (report may be
    NULL)."""
    last = stages.groupBy("model_key").agg(F.max_by("report", "stage").alias("last"))
    j = results.join(last, "model_key", "left")
    has = F.col("last").isNotNull()
    return j.select("model_key",
                    *[F.when(has, F.col(f"last.{m}")).otherwise(metric(m)).alias(m) for m in METRICS],
                    F.col("metrics.accuracy").alias("accuracy"),
                    F.when(has, "stage").otherwise("eval").alias("source"))


def stage_time_total(stages: DataFrame) -> DataFrame:
    """Training time of a run over its stages (a stage without a time counts 0)."""
    return stages.groupBy("model_key").agg(F.sum(F.coalesce("stage_time", F.lit(0.0))).alias("total_time"))


def top_runs(results: DataFrame, max_models: int) -> DataFrame:
    """The ``max_models`` best runs overall by F1 (ties in input order)."""
    return with_flags(results).withColumn("use_crf", F.col("flags.use_crf")).orderBy(F.desc(metric("f1")), "run_order").limit(max_models)
