"""Connected components of a link table, by alternating stars.

Each round points every node of a link at the smallest node its neighbourhood
knows, first over larger neighbours, then over smaller ones; the link table
never grows beyond its first size, minima are pre-aggregated before the
shuffle, and a hot node's links can be split by adaptive execution (plain inner
joins).  Rounds are written to the shared checkpoint folder, so lineage stays
short; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import stored


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links ``hi > lo``."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = large.join(low, "hi")
    small = joined.where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", "m"))
    return small.distinct()


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).collect()[0]
    return r.n, r.s


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for every node with a link; the root is the smallest node
    of its component (a root has no row of its own).  ``links`` has the columns
    ``a`` and ``b`` in any order; repeats and self-links are allowed."""
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), name)
    state = _state(now)
    while state[0]:
        now, before = stored(_stars(now), name), state
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
