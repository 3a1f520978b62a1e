"""Annotated-sample files: S1 read_samples, S2 scan_train_val, S3 generated
JSON round trip, S8 export_splits.

Files are written partitioned by ``split`` so that a reader asking for some
splits prunes whole directories (``PartitionFilters`` in the scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.schema import GENERATED, SAMPLE, SPLIT_ALIASES, SPLITS


def normalise_split(c):
    out = c
    for alias, name in SPLIT_ALIASES.items():
        out = F.when(c == alias, F.lit(name)).otherwise(out)
    return out


def write_samples(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S8 sink: one directory per split."""
    (df.write.mode("overwrite").partitionBy("split").format(fmt)
       .option("compression", "zstd" if fmt == "parquet" else "gzip").save(path))


def read_samples(spark: SparkSession, path: str, fmt: str = "parquet",
                 require_train: bool = True) -> DataFrame:
    """Annotated splits with ``val`` read as ``validation``; error when the
    train split is missing (checked with a one-row probe, not a count)."""
    df = spark.read.schema(SAMPLE).format(fmt).load(path)
    df = df.withColumn("split", normalise_split(F.col("split")))
    if require_train and not df.where(F.col("split") == "train").select("sample_id").take(1):
        raise ValueError(f"no train split under {path}")
    return df


def scan_train_val(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Only train and validation, so statistics never see the test split.
    ``val`` directories are included as validation."""
    df = spark.read.schema(SAMPLE).format(fmt).load(path)
    wanted = ["train", "validation"] + [a for a, n in SPLIT_ALIASES.items() if n == "validation"]
    return (df.where(F.col("split").isin(wanted))
              .withColumn("split", normalise_split(F.col("split"))))


def export_splits(df: DataFrame, path: str, seed: int | str = 42,
                  id_col: str = "sample_id") -> DataFrame:
    """Exact 80/10/10 split by the seeded order, written per split."""
    from spanweave.operators.sampling import exact_split
    out = exact_split(df.drop("split") if "split" in df.columns else df, id_col, seed)
    write_samples(out, path)
    return read_samples(df.sparkSession, path)


def write_generated(df: DataFrame, path: str) -> None:
    """S3 sink: generated samples as JSON Lines, non-ASCII kept as is."""
    (df.select("text", "entities").write.mode("overwrite")
       .option("ignoreNullFields", "false").json(path))


def read_generated(spark: SparkSession, path: str, array_form: bool = False) -> DataFrame:
    """S3 source: JSON Lines, or one JSON array of ``{text, entities}``
    (``array_form=True`` reads multi-line documents)."""
    r = spark.read.schema(GENERATED).option("mode", "PERMISSIVE")
    if array_form:
        r = r.option("multiLine", "true")
    return r.json(path)


__all__ = ["SPLITS", "read_samples", "scan_train_val", "export_splits", "write_samples",
           "write_generated", "read_generated", "normalise_split"]
