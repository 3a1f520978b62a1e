"""Generation planning: F11, F12, J6, W8, B4, B5, B6, F17.

Plans and task tables are sized by the requested sample count, not by the
corpus; only the statistics they start from (A1, W1, L2) read the corpus, and
those are aggregates.  Small per-type tables are broadcast into joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

# Auto top-n thresholds on target samples (fixed values).
THRESHOLDS = ((150, 30), (80, 20), (40, 15), (15, 10), (5, 5))
SMALLEST_TOP_N = 3


def generation_plan(dist: DataFrame, total_samples: int = 2000, avg_entities: int = 4,
                    top_n: int | None = None, samples_per_entity: int | None = None) -> DataFrame:
    """F11 (card C9): PLAN rows from ``type, ratio, unique_entities``."""
    ratio, uniq = F.col("ratio"), F.col("unique_entities")
    if top_n is not None and samples_per_entity is not None:
        tn = F.least(F.lit(top_n), uniq)
        spe = F.lit(samples_per_entity).cast("bigint")
        target = tn * spe
    else:
        t_ent = F.floor(F.lit(total_samples * avg_entities) * ratio).cast("bigint")
        target = F.greatest(F.lit(1), F.floor(t_ent / avg_entities)).cast("bigint")
        if top_n is not None:
            tn = F.least(F.lit(top_n), uniq)
            spe = F.greatest(F.lit(1), F.floor(target / F.greatest(F.lit(1), tn)))
        elif samples_per_entity is not None:
            tn = F.least(F.greatest(F.lit(1), F.floor(target / samples_per_entity)), uniq)
            spe = F.lit(samples_per_entity)
        else:
            tn = F.least(F.lit(SMALLEST_TOP_N), uniq)
            for lim, n in reversed(THRESHOLDS):
                tn = F.when(target >= lim, F.least(F.lit(n), uniq)).otherwise(tn)
            spe = F.greatest(F.lit(1), F.floor(target / F.greatest(F.lit(1), tn)))
    return dist.select("type", ratio.alias("ratio"), uniq.cast("bigint").alias("unique_entities"),
                       target.cast("bigint").alias("target_samples"), tn.cast("bigint").alias("top_n"),
                       spe.cast("bigint").alias("samples_per_entity"),
                       (tn * spe).cast("bigint").alias("estimated_samples"))


def proportional_alloc(top: DataFrame, total_samples: int) -> DataFrame:
    """samples per top entity = max(1, int(total * count / sum(count)))."""
    tot = top.agg(F.sum("n").alias("_tot"))
    return (top.crossJoin(F.broadcast(tot))
               .withColumn("num_samples", F.greatest(F.lit(1), F.floor(
                   F.lit(total_samples) * (F.col("n") / F.col("_tot")))).cast("bigint"))
               .drop("_tot"))


def plan_to_tasks(plan: DataFrame, ranked_names: DataFrame) -> DataFrame:
    """PLAN x its top names (``rank <= top_n``) x repetitions."""
    j = ranked_names.join(F.broadcast(plan.select("type", "top_n", "samples_per_entity", "ratio")),
                          "type").where(F.col("rank") <= F.col("top_n"))
    return j.select("type", "name", "rank", "ratio",
                    F.explode(F.sequence(F.lit(1), F.col("samples_per_entity").cast("int"))).alias("rep"))


def max_top_n(plan: DataFrame) -> int:
    """Names per type that the plan can ask for (one row)."""
    return int(plan.agg(F.coalesce(F.max("top_n"), F.lit(0))).first()[0])


def tasks_balanced(plan: DataFrame, ranked_names: DataFrame) -> DataFrame:
    """Mode 1, largest strata first.  A task's id is its type's offset plus
    its place in the type: only the per-type rows are put in order."""
    t = plan_to_tasks(plan, ranked_names)
    used = ranked_names.join(plan.select("type", "top_n", "samples_per_entity", "ratio"), "type").where("rank <= top_n")
    size = used.groupBy("type").agg((F.count(F.lit(1)) * F.first("samples_per_entity")).alias("size"), F.first("ratio").alias("r"),
                                    F.first("samples_per_entity").alias("each"))
    before = Window.orderBy(F.desc("r"), "type").rowsBetween(Window.unboundedPreceding, -1)   # one row per type
    offset = size.select("type", "each", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    t = t.join(offset, "type").withColumn(
        "task_id", (F.col("offset") + (F.col("rank") - 1) * F.col("each") + F.col("rep") - 1).cast("bigint"))
    return t.select("task_id", F.col("type").alias("primary_type"),
                    F.array(F.struct("name", "type")).alias("targets"))


def tasks_topn(top: DataFrame, total_samples: int) -> DataFrame:
    """Mode 2: global top entities, proportional counts, repeated."""
    a = proportional_alloc(top, total_samples)
    before = Window.orderBy(F.desc("n"), "type", "name").rowsBetween(Window.unboundedPreceding, -1)   # the requested top names
    a = a.withColumn("offset", F.coalesce(F.sum("num_samples").over(before), F.lit(0)))
    t = a.select("name", "type", "n", "offset", F.explode(F.sequence(F.lit(1), F.col("num_samples").cast("int"))).alias("rep"))
    t = t.withColumn("task_id", (F.col("offset") + F.col("rep") - 1).cast("bigint"))
    return t.select("task_id", F.col("type").alias("primary_type"),
                    F.array(F.struct("name", "type")).alias("targets"))


def hash_index(seed: int | str, *parts: Column) -> Column:
    """Non-negative 32-bit index from ``md5('<seed>:p1:p2...')``."""
    key = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def tasks_uniform_multi(spark: SparkSession, ranked_names: DataFrame, total_tasks: int,
                        entities_per_sample: int = 3, seed: int | str = 42, types: DataFrame | None = None) -> DataFrame:
    """B6 (card C6): primary type ``types[i mod T]`` (types sorted), a seeded
    name of that type, plus ``entities_per_sample - 1`` other types drawn
    without repetition in ``md5(seed:task:type)`` order, each with a seeded
    name.  ``types`` (the distribution's types; by default those with names)
    take turns whether or not they have names; a type without names wastes its
    draw.  Returns ``task_id, slot, type, name``."""
    types = (ranked_names if types is None else types).select("type").distinct()
    counts = ranked_names.groupBy("type").agg(F.max("rank").alias("cnt"))
    tlist = types.agg(F.array_sort(F.collect_list("type")).alias("ts"))
    tasks = spark.range(total_tasks).withColumnRenamed("id", "task_id")
    prim = (tasks.crossJoin(F.broadcast(tlist))
                 .select("task_id", "ts", F.element_at("ts", (F.col("task_id") % F.size("ts")).cast("int") + 1)
                         .alias("primary_type")))
    others = (prim.select("task_id", "primary_type", F.explode("ts").alias("type"))
                  .where(F.col("type") != F.col("primary_type"))
                  .withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("task_id").cast("string"), "type")))
                  .withColumn("slot", F.row_number().over(Window.partitionBy("task_id").orderBy("h", "type")))
                  .where(F.col("slot") <= entities_per_sample - 1)
                  .select("task_id", "slot", "type"))
    slots = prim.select("task_id", F.lit(0).alias("slot"), F.col("primary_type").alias("type")).unionByName(others)
    pick = (slots.join(F.broadcast(counts), "type")
                 .withColumn("rank", (hash_index(seed, F.col("task_id"), F.col("type")) % F.col("cnt")) + 1))
    named = pick.join(ranked_names.select("type", "rank", "name"), ["type", "rank"])
    return named.select("task_id", F.col("slot").cast("bigint").alias("slot"), "type", "name")


def custom_id(task_id: Column) -> Column:
    """the request id of a task."""
    return F.format_string("req_%06d", task_id)


def request_ids(tasks: DataFrame, chunk_size: int = 10) -> DataFrame:
    """``req_%06d`` ids, chunk number and chunk count."""
    n = tasks.agg(F.count(F.lit(1)).alias("_n"))
    return (tasks.crossJoin(F.broadcast(n))
                 .select("task_id", custom_id(F.col("task_id")).alias("custom_id"),
                         F.floor(F.col("task_id") / chunk_size).cast("bigint").alias("chunk"),
                         F.ceil(F.col("_n") / chunk_size).cast("bigint").alias("n_chunks")))
