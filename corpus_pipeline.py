"""Training-data pipeline: quality, line dedup, near dedup, decontamination, packing.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame that is written as Parquet and read back as the next
one's ``docs``.  All but the last return the columns of ``docs``.

Defined results, beyond those of the operators: rows keep their other columns;
``n_chars``, where there is one, follows the text; documents whose lines were
all dropped as repeats go with them (texts that were empty before stay); a
document that holds a benchmark item goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import common, dart_minhash, line_crf, line_templates, nnls_packing, simhash_windows
from spanweave.session import ship_package


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the line field doesn't reject."""
    ship_package(spark)
    model = line_crf.train(docs, common.table(spark, sf_dir, "labels"))
    scored = line_crf.quality_scores(docs, model, tuple(docs.columns), "_sw_score")
    return scored.where(F.col("_sw_score") >= line_crf.THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates (their first line stays)."""
    out = line_templates.drop_templates(docs)
    out = out.where((F.col("lines_dropped") == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("lines_dropped") == 0, F.col("n_chars"))
                             .otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    ship_package(spark)
    return dart_minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    hits = simhash_windows.benchmark_hits(docs, common.table(spark, sf_dir, "benchmark"))
    found = common.stored(hits.select(F.col("k").alias("_sw_k")).distinct(), "contaminated")
    flagged = common.member_flag(docs.withColumn("_sw_k", common.row_key()), found, "_sw_k")
    # only the few rows that may hold an item meet the exact list
    checked = flagged.where("_sw_maybe").join(found, "_sw_k", "left_anti")
    return flagged.where("not _sw_maybe").select(*docs.columns).union(checked.select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences without padding."""
    ship_package(spark)
    return nnls_packing.digests(nnls_packing.pack(docs))


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("packing", packing)]

# A fitted field can't be restated in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.scope(spark):  # what a stage writes on its way goes with it
            docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return docs
