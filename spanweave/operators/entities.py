"""Corpus statistics over annotated samples: P1-P4, P11, A1-A4, A10, A18, W1, L1, L2.

Plans aggregate before they rank: rankings run over ``(name, type, count)``
rows, never over raw entities, and per-type winners come from an aggregate
(``min`` of a struct), so a dominant type does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanweave.schema import BAD_CHAR_CLASS, MIN_EXAMPLE_ENTITIES, SPLITS


def is_clean(c: Column) -> Column:
    return ~c.rlike(BAD_CHAR_CLASS)


def drop_unannotated(samples: DataFrame) -> DataFrame:
    """Skip samples without entities."""
    return samples.where(F.size(F.coalesce("entities", F.array())) > 0)


def explode_entities(samples: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per entity, missing keys defaulted (``''``, span ``[0, 0]``).

    Returns ``sample_id, ent_idx, type, name, start, end`` (ENTITY).
    """
    s = samples if keep_empty else drop_unannotated(samples)
    e = s.select("sample_id", F.posexplode(F.coalesce("entities", F.array())).alias("ent_idx", "ent"))
    span = F.coalesce(F.col("ent.span"), F.array(F.lit(0), F.lit(0)))
    return e.select(
        "sample_id", F.col("ent_idx").cast("int").alias("ent_idx"),
        F.coalesce(F.col("ent.type"), F.lit("")).alias("type"),
        F.coalesce(F.col("ent.name"), F.lit("")).alias("name"),
        F.coalesce(F.try_element_at(span, F.lit(1)), F.lit(0)).cast("int").alias("start"),
        F.coalesce(F.try_element_at(span, F.lit(2)), F.lit(0)).cast("int").alias("end"))


def clean_entity_names(entities: DataFrame) -> DataFrame:
    """Entities whose name has none of the garbling characters."""
    return entities.where(is_clean(F.col("name")))


def clean_samples(samples: DataFrame, min_entities: int = MIN_EXAMPLE_ENTITIES) -> DataFrame:
    """Text and every entity name clean, and at least ``min_entities``."""
    ents = F.coalesce("entities", F.array())
    return samples.where(
        is_clean(F.col("text"))
        & F.forall(ents, lambda x: ~F.coalesce(x["name"], F.lit("")).rlike(BAD_CHAR_CLASS))
        & (F.size(ents) >= min_entities))


def row_text(df: DataFrame) -> Column:
    """Text of a row: ``text``, else the joined ``tokens``."""
    cols = set(df.columns)
    parts = []
    if "text" in cols:
        parts.append(F.col("text"))
    if "tokens" in cols:
        parts.append(F.array_join("tokens", ""))
    parts.append(F.lit(""))
    return F.coalesce(*parts)


def entity_distribution(entities: DataFrame, digits: int | None = 6) -> DataFrame:
    """A1: per type count, share of all entities, distinct clean names.

    Garbled names count in the totals but not among the unique names.
    """
    per = entities.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.when(is_clean(F.col("name")), F.col("name"))).alias("unique_entities"))
    w = Window.partitionBy()  # over the handful of per-type rows only
    ratio = F.col("n") / F.sum("n").over(w)
    if digits is not None:
        ratio = F.round(ratio, digits)
    return per.select("type", "n", ratio.alias("ratio"), "unique_entities")


def corpus_totals(samples: DataFrame) -> DataFrame:
    """A3: annotated samples, entities and distinct types (one row)."""
    s = drop_unannotated(samples)
    totals = s.agg(F.count(F.lit(1)).alias("samples"),
                   F.coalesce(F.sum(F.size("entities")), F.lit(0)).cast("bigint").alias("entities"))
    types = (s.select(F.explode(F.transform("entities", lambda x: x["type"])).alias("type"))
              .agg(F.count_distinct("type").alias("types")))
    return totals.crossJoin(types)


def name_type_freq(entities: DataFrame) -> DataFrame:
    """A4: frequency of ``(name, type)`` over clean names."""
    return (clean_entity_names(entities).groupBy("name", "type")
            .agg(F.count(F.lit(1)).alias("n")))


def top_entities_per_type(entities: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent clean names of each type (ties by name).

    ``rn <= n`` over a window lets Spark insert a partial group limit before
    the exchange, so each partition ships at most n rows per type.
    """
    f = name_type_freq(entities)
    w = Window.partitionBy("type").orderBy(F.desc("n"), F.asc("name"))
    return f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def global_top_entities(entities: DataFrame, n: int) -> DataFrame:
    """L2 (card C5): the most frequent name of every type first, then the
    rest by frequency, sorted by count, cut to n.

    Per-type winners come from an aggregate (map-side combined); the fill is a
    top-k.  Order: count desc, type, name.
    """
    f = name_type_freq(entities)
    best = (f.groupBy("type")
             .agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("name").alias("name"))).alias("b"))
             .select(F.col("b.name").alias("name"), "type", F.lit(True).alias("first")))
    # one row per type: broadcast it to flag the winners, then one top-k
    flagged = f.join(F.broadcast(best), ["name", "type"], "left").fillna(False, ["first"])
    return (flagged.orderBy(F.desc("first"), F.desc("n"), "type", "name").limit(n)
                   .select("name", "type", F.col("n").cast("bigint").alias("n")))


def few_shot_richest(samples: DataFrame, n: int = 3,
                     min_entities: int = MIN_EXAMPLE_ENTITIES) -> DataFrame:
    """L1: n clean samples with the most entities (ties by sample id)."""
    c = clean_samples(samples, min_entities)
    return (c.withColumn("n_entities", F.size("entities"))
             .orderBy(F.desc("n_entities"), "sample_id").limit(n))


def split_sizes(samples: DataFrame) -> DataFrame:
    """Rows per split, 0 for an absent split."""
    names = samples.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    counts = samples.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(names).join(counts, "split", "left")
            .select("split", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def type_sets(samples: DataFrame) -> DataFrame:
    """Sorted distinct types of each sample (``[]`` when it has none)."""
    ts = F.array_sort(F.array_distinct(F.transform(F.coalesce("entities", F.array()),
                                                   lambda x: x["type"])))
    return samples.withColumn("type_set", ts)


def type_set_groups(samples: DataFrame) -> DataFrame:
    """A10: samples grouped by their sorted set of types (computed inside each
    row, so only the groups are shuffled)."""
    return (type_sets(samples).groupBy("type_set")
            .agg(F.count(F.lit(1)).alias("samples")))
