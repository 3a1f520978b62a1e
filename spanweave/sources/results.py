"""Run documents: S5 read_results, S6 write_results, S7 export_summary, J9 merge_run_sets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.schema import RESULT

_CORRUPT = "_corrupt_record"


def write_results(results: DataFrame, path: str) -> None:
    """One folder per run (``<model_key>_<timestamp>``) with one indented
    JSON document; the model key is inside the document."""
    run = F.concat_ws("_", "model_key", F.coalesce("timestamp", F.lit("none"))).alias("run")
    doc = F.to_json(F.struct(*results.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")
    results.select(run, doc).repartition("run").write.mode("overwrite").partitionBy("run").text(path)


def read_results(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Load run documents, one (indented or not) per file, by folder or
    glob.  Unreadable documents are skipped and none found is an error.
    Missing optional fields stay NULL; a missing model key is the name of the
    document's folder."""
    paths = [paths] if isinstance(paths, str) else paths
    schema = T.StructType(list(RESULT.fields) + [T.StructField("run_order", T.IntegerType()),
                                                 T.StructField(_CORRUPT, T.StringType())])
    df = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", True)
               .option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", _CORRUPT).json(paths))
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    ok = df.select("*", folder.alias("_folder")).where(F.col(_CORRUPT).isNull() & F.col("status").isNotNull())
    ok = ok.withColumn("model_key", F.coalesce("model_key", F.regexp_replace("_folder", "^run=", ""))).drop(_CORRUPT, "_folder")
    if not ok.select("status").take(1):
        raise FileNotFoundError(f"no readable run results under {paths}")
    return ok


def merge_run_sets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Results of this run plus ``compare_with`` directories; missing
    directories are ignored."""
    frames = []
    for p in paths:
        try:
            frames.append(read_results(spark, p))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if not frames:
        raise FileNotFoundError("none of the result directories exists")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def comparison_table(results: DataFrame) -> DataFrame:
    """The comparison report of successful runs, best F1 first (ties in
    input order), under its column names."""
    return results.where("status = 'success'").orderBy(F.desc("metrics.f1"), "run_order").select(
        F.col("model_key").alias("Model"), F.col("model_name").alias("Model Full Name"), F.col("metrics.f1").alias("F1"),
        F.col("metrics.precision").alias("Precision"), F.col("metrics.recall").alias("Recall"), F.col("metrics.accuracy").alias("Accuracy"),
        F.col("training_time").alias("Training Time (s)"), F.col("num_samples.train").alias("Training Samples"), F.col("num_samples.test").alias("Test Samples"))


def export_comparison(results: DataFrame, path: str) -> None:
    """The comparison report as one CSV file in its order (a row per run)."""
    comparison_table(results).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def export_summary(summary: DataFrame, path: str) -> None:
    """The summary table as CSV (with header) and as JSON."""
    summary.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    summary.write.mode("overwrite").json(f"{path}/json")
