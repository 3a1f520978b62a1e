"""Composite generation jobs: B12 verify_generated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.operators import verify as V


def verify_generated(real_dist: DataFrame, generated_entities: DataFrame, digits: int = 6) -> DataFrame:
    """Per real type the real and generated shares, their difference, and
    the overall mean absolute difference with its verdict (J5 + A9)."""
    d = V.distribution_diff(real_dist, generated_entities)
    m = V.distribution_mad(d)
    return (d.crossJoin(F.broadcast(m))
             .select("type", F.round("real_ratio", digits).alias("real_ratio"),
                     F.round("gen_ratio", digits).alias("gen_ratio"), F.round("diff", digits).alias("diff"),
                     F.round("mad", digits).alias("mad"), "verdict"))
