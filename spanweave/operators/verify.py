"""Generated vs real distribution: A2, J5, A9, B12."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.schema import MAD_FAIR, MAD_GOOD


def generated_distribution(entities: DataFrame) -> DataFrame:
    """A2: per-type count and share in a generated set (share 0 when empty)."""
    c = entities.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum("n").alias("_t"))
    return (c.crossJoin(F.broadcast(tot))
             .select("type", "n", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("_t")),
                                             F.lit(0.0)).alias("ratio")))


def distribution_diff(real: DataFrame, generated: DataFrame) -> DataFrame:
    """Real types left-joined to generated counts (missing = 0); types only
    in the generated set are not listed but count in its total."""
    g = generated_distribution(generated)
    r = real.select("type", F.col("ratio").alias("real_ratio"))
    j = r.join(g.select("type", F.col("n").alias("gen_n"), F.col("ratio").alias("gen_ratio")), "type", "left")
    return j.select("type", "real_ratio", F.coalesce("gen_n", F.lit(0)).cast("bigint").alias("gen_n"),
                    F.coalesce("gen_ratio", F.lit(0.0)).alias("gen_ratio"),
                    (F.coalesce("gen_ratio", F.lit(0.0)) - F.col("real_ratio")).alias("diff"))


def distribution_mad(diff: DataFrame) -> DataFrame:
    """Mean absolute share difference and its verdict."""
    m = diff.agg(F.coalesce(F.avg(F.abs("diff")), F.lit(0.0)).alias("mad"))
    verdict = (F.when(F.col("mad") < MAD_GOOD, "good").when(F.col("mad") < MAD_FAIR, "fair")
                .otherwise("poor"))
    return m.select("mad", verdict.alias("verdict"))
