"""B11 full_report: the report tables written side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.operators import runs as RN
from spanweave.sources.results import comparison_table, export_comparison, export_summary


DIGITS = 6  # of the metrics in a digest


def full_report(results: DataFrame, path: str, model_keys: list[str]) -> DataFrame:
    """Summary (CSV + JSON), comparison report, metric rankings, time ranking,
    radar matrix, best run per type and precision-recall points; returns an
    index ``table, rows, content, path``: ``content`` is the md5 of the written
    rows with their ranks and metrics, in the table's order."""
    ok = RN.successful_runs(results, require=True)
    spark = results.sparkSession
    ranked = lambda by: RN.run_ranking(ok, by).select("rank", "model_key", RN.metric(by).alias(by))
    tables = {
        **{f"ranking_{by}": (ranked(by), ["rank"]) for by in ("f1", "precision", "recall")},
        "time_ranking": (RN.time_ranking(ok).select("rank", "model_key", "training_time"), ["rank"]),
        "radar": (RN.radar_matrix(ok, model_keys), ["type"]),
        "best_per_type": (RN.best_run_per_type(ok).select("type", "model_key", "f1"), ["type"]),
        "pr_points": (RN.per_type(ok).select("type", "model_key", "precision", "recall", "f1"), ["type", "model_key"]),
    }
    summary = RN.summary_table(ok)
    export_summary(summary, f"{path}/summary")
    comparison = comparison_table(results)
    export_comparison(results, f"{path}/comparison")
    written = {"summary": (spark.read.schema(summary.schema).json(f"{path}/summary/json"), ["-f1", "run_order"]),
               "comparison": (spark.read.option("header", True).schema(comparison.schema).csv(f"{path}/comparison"), ["-F1", "Model"])}
    for name, (df, order) in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        written[name] = (spark.read.parquet(f"{path}/{name}"), order)
    index = [_entry(name, df, order) for name, (df, order) in written.items()]
    return reduce(DataFrame.union, index).withColumn("path", F.lit(path))


def _shown(df: DataFrame, name: str) -> Column:
    """A value as the digest shows it: doubles with six digits."""
    c = F.col(f"`{name}`")
    c = F.format_string(f"%.{DIGITS}f", F.round(c, DIGITS)) if df.schema[name].dataType.typeName() == "double" else c.cast("string")
    return F.coalesce(c, F.lit("null"))


def _entry(name: str, df: DataFrame, order: list[str]) -> DataFrame:
    """One row about a written table (tables of runs and types, a few rows each);
    a minus in the order means descending."""
    keys = [(-F.col(f"`{o[1:]}`") if o.startswith("-") else F.col(f"`{o}`")).alias(f"k{i}") for i, o in enumerate(order)]
    row = F.concat_ws("|", *[_shown(df, c) for c in df.columns if c != "run_order"])
    rows = F.sort_array(F.collect_list(F.struct(*keys, row.alias("row"))))
    content = F.md5(F.array_join(F.transform(rows, lambda x: x["row"]), "\n"))
    return df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), content.alias("content")).select("table", "rows", "content")
