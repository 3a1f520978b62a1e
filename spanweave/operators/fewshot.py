"""Few-shot selection: W2 running_type_score, L7 diverse, L8 stratified,
and the strategy switch (unknown names fall back to random).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanweave.operators.entities import type_sets
from spanweave.operators.sampling import few_shot_random, hash_key
from spanweave.session import ensure_checkpoint_dir

ROWS_PER_TASK = 50_000  # rows of one window, about
MAX_BUCKETS = 4096


def _bucket(bounds: list, of: Column) -> Column:
    """How many of the sorted bounds are smaller, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = math.ceil(math.sqrt(len(bounds)))
    every = F.array(*[F.lit(x) for x in bounds])
    coarse = F.size(F.filter(F.array(*[F.lit(x) for x in bounds[::step]]), lambda x: x < of))
    fine = F.size(F.filter(F.slice(every, F.greatest(coarse - 1, F.lit(0)) * step + 1, F.lit(step)), lambda x: x < of))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)


def type_occurrences(samples: DataFrame, id_col: str = "sample_id", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``id_col, type, c, b``: occurrences of each type in each sample, and the
    bucket of the id.  Buckets are id quantiles of about ``rows_per_task`` rows,
    so they are even however sparse the ids are and their number follows the
    data (up to ``MAX_BUCKETS``)."""
    per = (samples.select(id_col, F.explode(F.transform(F.coalesce("entities", F.array()),
                                                        lambda x: x["type"])).alias("type"))
                  .groupBy(id_col, "type").agg(F.count(F.lit(1)).alias("c")))
    grid = [i / MAX_BUCKETS for i in range(1, MAX_BUCKETS)]
    found = per.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(id_col, grid, 100 * MAX_BUCKETS).alias("q")).first()
    wanted = min(MAX_BUCKETS, math.ceil(found["n"] / rows_per_task))
    cuts = sorted({found["q"][round(i * MAX_BUCKETS / wanted) - 1] for i in range(1, wanted)}) if wanted > 1 else []
    return per.withColumn("b", _bucket(cuts, F.col(id_col)))


def running_type_score(samples: DataFrame, id_col: str = "sample_id", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """For each sample in id order, the sum over its types of that type's
    count so far (this sample included).

    A running count partitioned only by type would put a dominant type in one
    task.  Two levels instead: running totals of the (bucket, type) sums, one
    row per bucket, then a running sum inside each (bucket, type).
    """
    per = type_occurrences(samples, id_col, rows_per_task)
    tot = per.groupBy("b", "type").agg(F.sum("c").alias("bt"))
    off = tot.withColumn("off", F.sum("bt").over(
        Window.partitionBy("type").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["off"])
    run = per.withColumn("r", F.sum("c").over(
        Window.partitionBy("b", "type").orderBy(id_col).rowsBetween(Window.unboundedPreceding, 0)))
    run = run.join(off.select("b", "type", "off"), ["b", "type"])
    return (run.groupBy(id_col).agg(F.sum(F.col("r") + F.col("off")).cast("bigint").alias("score")))


def few_shot_diverse(samples: DataFrame, k: int, seed: int | str = 42, id_col: str = "sample_id") -> DataFrame:
    """Round-robin over shuffled type sets (the empty set included), a
    random member each time; stops when the pool is exhausted (D22)."""
    ts = type_sets(samples).select(id_col, "type_set")
    ranked = (ts.withColumn("ts_key", F.array_join("type_set", ",")).withColumn("h", hash_key(id_col, seed))
                .withColumn("g", F.md5(F.concat(F.lit(f"{seed}:"), F.col("ts_key"))))
                # only the first k of a set can be picked: every task keeps that many ids before the exchange
                .withColumn("round", F.row_number().over(Window.partitionBy("type_set").orderBy("h", id_col)))
                .where(F.col("round") <= k))
    picked = ranked.orderBy("round", "g", "ts_key").limit(k).drop("h", "g", "type_set")
    return type_sets(samples).join(picked, id_col)


def few_shot_stratified(samples: DataFrame, k: int, id_col: str = "sample_id") -> DataFrame:
    """L8 (card C8): greedy cover of types by global frequency with the best
    W2 score first, then fill by score from samples having any type.

    Only the best sample of each distinct type set can be picked during the
    cover.  Those stay on the cluster, however many type sets there are: every
    pick is an aggregate over them, and only the pick (and one row per type)
    reaches the driver; the fill is a top-k.
    """
    if k <= 0:
        return samples.limit(0)
    ensure_checkpoint_dir(samples.sparkSession)
    sc = running_type_score(samples, id_col)
    ts = type_sets(samples).select(id_col, "type_set").join(sc, id_col).checkpoint()
    best = ts.groupBy("type_set").agg(F.min(F.struct((-F.col("score")).alias("k"), F.col(id_col).alias("i"))).alias("b")).checkpoint()
    freq = (samples.select(F.explode(F.transform(F.coalesce("entities", F.array()), lambda x: x["type"])).alias("type"))
                   .groupBy("type").count().orderBy(F.desc("count"), "type").collect())
    covered, chosen = set(), []
    for row in freq:
        t = row["type"]
        if t in covered or len(chosen) >= k:
            continue
        pick = best.where(F.array_contains("type_set", t)).agg(F.min(F.struct("b", "type_set")).alias("p")).first()["p"]
        chosen.append(pick["b"]["i"])
        covered.update(pick["type_set"])
    first = samples.where(F.col(id_col).isin(chosen)) if chosen else samples.limit(0)
    rest_n = k - len(chosen)
    if rest_n <= 0:
        return first.withColumn("phase", F.lit("cover"))
    fill = (ts.where(~F.col(id_col).isin(chosen))
              .orderBy(F.desc("score"), id_col).limit(rest_n).select(id_col))
    return (first.withColumn("phase", F.lit("cover"))
                 .unionByName(samples.join(fill, id_col, "left_semi").withColumn("phase", F.lit("fill"))))


def select_few_shot(samples: DataFrame, k: int, strategy: str = "random", seed: int | str = 42) -> DataFrame:
    """Strategy switch: random / diverse / stratified; unknown -> random."""
    if strategy == "diverse":
        return few_shot_diverse(samples, k, seed)
    if strategy == "stratified":
        return few_shot_stratified(samples, k)
    return few_shot_random(samples, k, seed)
