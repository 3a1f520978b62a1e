"""Readers for the driver's parquet tables.

Only the columns an operator needs are selected by the callers, so Catalyst
prunes the parquet scan (``ReadSchema``) and pushes filters down.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row work at least one input partition per core.

    A split of a Parquet file only reads the row groups that begin in it, so a
    file of one row group is one task however many splits it has.  Rows are
    counted per partition (a scan without columns: footers only); where fewer
    partitions than cores have rows, or one holds more than twice a core's
    share, a round-robin repartition deals them out.  Other inputs pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= cores:
        counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]  # one number a split
        if len(counts) >= cores and max(counts) * cores <= 2 * sum(counts):
            return df
    return df.repartition(max(cores, splits))


def keep_if(df: DataFrame, cond) -> DataFrame:
    """Filter on a column computed by per-row array work.

    A plain ``where`` is pushed by the optimizer below the projection that
    computes the column (and below a ``spread`` exchange), so the expensive
    expression would run twice, the first time before the input is spread.
    A one-element generator keeps the predicate where it is written and reads
    the computed column.
    """
    return (df.select("*", F.explode(F.when(cond, F.array(F.lit(True)))).alias("_keep"))
              .drop("_keep"))


def explode_rows(df: DataFrame, arr, keep: list[str], pos_name: str | None = None,
                 name: str = "value") -> DataFrame:
    """Rows of a computed array without re-computing it.

    For a plain ``explode``/``inline`` the optimizer infers ``size(arr) > 0``
    and pushes that filter below the projection that computes ``arr``, which
    evaluates the array expression twice.  The outer generator infers
    nothing; rows of empty arrays (NULL position) are dropped afterwards.
    Struct elements are expanded into columns.
    """
    from pyspark.sql import types as T
    e = df.select(*keep, F.posexplode_outer(arr).alias("_pos", "_x")).where(F.col("_pos").isNotNull())
    pos = [F.col("_pos").alias(pos_name)] if pos_name else []
    if isinstance(e.schema["_x"].dataType, T.StructType):
        return e.select(*keep, *pos, "_x.*")
    return e.select(*keep, *pos, F.col("_x").alias(name))
