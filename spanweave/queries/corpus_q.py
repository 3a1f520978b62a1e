"""Corpus statistics, splits and sample files (S1-S3, S8, P1-P4, P11, A1,
A3, A4, A10, A18, W1, W6, W7, L1, L2, L5, L6, U1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanweave import oracle as O
from spanweave.catalog import register
from spanweave.operators import entities as ent
from spanweave.operators import sampling
from spanweave.session import scratch_path
from spanweave.sources import fixtures as fx
from spanweave.sources import samples as S
from spanweave.sources.corpus import doc_lines

_G = O.cand_ctes(garbled=True)
_C = O.cand_ctes()
_BAD = "'[?☆〈〉]'"

_ENT = """ent AS (
  SELECT doc_id AS sample_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS BIGINT) AS ent_idx,
         type, name, s AS start, e AS "end" FROM gold)"""
_SAMP = f"""samp AS (
  SELECT d.doc_id AS sample_id, d.text, CAST(coalesce(k.n, 0) AS BIGINT) AS n_entities,
         coalesce(k.bad, 0) AS bad
  FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n,
                                count(*) FILTER (WHERE regexp_matches(name, {_BAD})) AS bad
                         FROM gold GROUP BY doc_id) k USING (doc_id))"""
_FREQ = f"""f AS (SELECT name, type, CAST(count(*) AS BIGINT) AS n FROM gold
          WHERE NOT regexp_matches(name, {_BAD}) GROUP BY name, type)"""


def _ents(spark, sf, garbled=True):
    return ent.explode_entities(fx.samples(spark, sf, garbled=garbled, with_split=False))


def _long(df):
    return df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c)
                       for c, t in df.dtypes])


@register("explode_entities", O.with_(_G, _ENT) + 'SELECT sample_id, ent_idx, type, name, start, "end" FROM ent')
def explode_entities(spark, sf):
    return _long(_ents(spark, sf))


@register("drop_unannotated", O.with_(_G, _SAMP) + "SELECT sample_id, n_entities FROM samp WHERE n_entities > 0")
def drop_unannotated(spark, sf):
    s = ent.drop_unannotated(fx.samples(spark, sf, garbled=True, with_split=False))
    return s.select("sample_id", F.size("entities").cast("bigint").alias("n_entities"))


@register("clean_entity_names", O.with_(_G, _ENT) +
          f"SELECT sample_id, ent_idx, type, name FROM ent WHERE NOT regexp_matches(name, {_BAD})")
def clean_entity_names(spark, sf):
    return _long(ent.clean_entity_names(_ents(spark, sf)).select("sample_id", "ent_idx", "type", "name"))


@register("clean_samples", O.with_(_G, _SAMP) +
          f"SELECT sample_id, n_entities FROM samp WHERE NOT regexp_matches(text, {_BAD}) AND bad = 0 AND n_entities >= 10")
def clean_samples(spark, sf):
    s = ent.clean_samples(fx.samples(spark, sf, garbled=True, with_split=False))
    return s.select("sample_id", F.size("entities").cast("bigint").alias("n_entities"))


@register("entity_distribution", O.with_(_G) + f"""
SELECT type, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS ratio,
       CAST(count(DISTINCT name) FILTER (WHERE NOT regexp_matches(name, {_BAD})) AS BIGINT) AS unique_entities
FROM gold GROUP BY type""")
def entity_distribution(spark, sf):
    return ent.entity_distribution(_ents(spark, sf))


@register("corpus_totals", O.with_(_G) + """
SELECT CAST(count(DISTINCT doc_id) AS BIGINT) AS samples, CAST(count(*) AS BIGINT) AS entities,
       CAST(count(DISTINCT type) AS BIGINT) AS types FROM gold""")
def corpus_totals(spark, sf):
    return ent.corpus_totals(fx.samples(spark, sf, garbled=True, with_split=False))


@register("name_type_freq", O.with_(_G, _FREQ) + "SELECT name, type, n FROM f")
def name_type_freq(spark, sf):
    return ent.name_type_freq(_ents(spark, sf))


@register("top_entities_per_type", O.with_(_G, _FREQ) + """
SELECT name, type, n, rank FROM (
  SELECT name, type, n, CAST(row_number() OVER (PARTITION BY type ORDER BY n DESC, name) AS BIGINT) AS rank
  FROM f) WHERE rank <= 5""")
def top_entities_per_type(spark, sf):
    return _long(ent.top_entities_per_type(_ents(spark, sf), 5))


@register("global_top_entities", O.with_(_G, _FREQ) + """
SELECT name, type, n FROM (
  SELECT name, type, n, row_number() OVER (PARTITION BY type ORDER BY n DESC, name) AS rk FROM f)
ORDER BY (rk = 1) DESC, n DESC, type, name LIMIT 20""")
def global_top_entities(spark, sf):
    return ent.global_top_entities(_ents(spark, sf), 20)


@register("few_shot_richest", O.with_(_G, _SAMP) + f"""
SELECT sample_id, n_entities FROM samp
WHERE NOT regexp_matches(text, {_BAD}) AND bad = 0 AND n_entities >= 10
ORDER BY n_entities DESC, sample_id LIMIT 3""")
def few_shot_richest(spark, sf):
    s = ent.few_shot_richest(fx.samples(spark, sf, garbled=True, with_split=False), 3)
    return s.select("sample_id", F.col("n_entities").cast("bigint"))


@register("exact_split", O.with_(O.split_cte()) + "SELECT doc_id AS sample_id, split FROM splits")
def exact_split(spark, sf):
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    return sampling.exact_split(d, "sample_id", 42)


@register("split_sizes", O.with_(O.split_cte()) + """
SELECT v.split, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (VALUES ('train'), ('validation'), ('test')) v(split)
LEFT JOIN (SELECT split, count(*) AS n FROM splits GROUP BY split) c USING (split)""")
def split_sizes(spark, sf):
    return ent.split_sizes(fx.samples(spark, sf))


@register("type_set_groups", O.with_(_C) + """
SELECT type_set, CAST(count(*) AS BIGINT) AS samples FROM (
  SELECT d.doc_id, coalesce(string_agg(DISTINCT g.type, ',' ORDER BY g.type), '') AS type_set
  FROM docs d LEFT JOIN gold g USING (doc_id) GROUP BY d.doc_id) GROUP BY type_set""")
def type_set_groups(spark, sf):
    g = ent.type_set_groups(fx.samples(spark, sf, with_split=False))
    return g.select(F.array_join("type_set", ",").alias("type_set"), F.col("samples").cast("bigint"))


@register("row_text", O.with_(O.docs_cte()) + """
SELECT doc_id, form, CAST(length(text) AS BIGINT) AS n_chars FROM (
  SELECT doc_id, 'text' AS form, text FROM docs
  UNION ALL SELECT doc_id, 'tokens', replace(text, ' ', '') FROM docs)""")
def row_text(spark, sf):
    d = fx.docs(spark, sf)
    as_text = d.select("doc_id", F.lit("text").alias("form"), "text", F.lit(None).cast("array<string>").alias("tokens"))
    as_toks = d.select("doc_id", F.lit("tokens").alias("form"), F.lit(None).cast("string").alias("text"),
                       F.split("text", " ", -1).alias("tokens"))
    both = as_text.unionByName(as_toks)
    return both.select("doc_id", "form", F.length(ent.row_text(both)).cast("bigint").alias("n_chars"))


_LINES = """lines AS (
  SELECT doc_id * 1000000000 + pos AS line_id, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))"""
_LRANK = """lr AS (SELECT line_id, line, row_number() OVER (ORDER BY md5(concat('42:', CAST(line_id AS VARCHAR))), line_id) AS rn,
               count(*) OVER () AS n FROM lines)"""


@register("holdout_split", O.with_(_LINES, _LRANK) +
          "SELECT line_id, CASE WHEN rn <= n - ceil(0.1 * n) THEN 'train' ELSE 'test' END AS split FROM lr")
def holdout_split(spark, sf):
    return sampling.holdout_split(doc_lines(spark, sf).select("line_id"), "line_id", 42)


@register("sample_lines", O.with_(_LINES, _LRANK) +
          "SELECT line_id, line AS text FROM lr WHERE rn <= 1000 AND trim(line) <> ''")
def sample_lines(spark, sf):
    return sampling.sample_lines(doc_lines(spark, sf), 1000, 42)


@register("few_shot_pool", O.with_(O.split_cte()) +
          "SELECT doc_id AS sample_id, split FROM splits WHERE split IN ('train', 'validation')")
def few_shot_pool(spark, sf):
    return sampling.few_shot_pool(fx.samples(spark, sf)).select("sample_id", "split")


@register("few_shot_random", O.with_(O.split_cte()) + """
SELECT doc_id AS sample_id FROM splits WHERE split IN ('train', 'validation')
ORDER BY md5(concat('7:', CAST(doc_id AS VARCHAR))), doc_id LIMIT 5""")
def few_shot_random(spark, sf):
    pool = sampling.few_shot_pool(fx.samples(spark, sf))
    return sampling.few_shot_random(pool, 5, seed=7).select("sample_id")


_FILE_SQL = O.with_(_C, O.split_cte(), """k AS (
  SELECT s.doc_id AS sample_id, s.split, CAST(count(g.doc_id) AS BIGINT) AS n_entities
  FROM splits s LEFT JOIN gold g USING (doc_id) GROUP BY s.doc_id, s.split)""")


def _written(spark, sf, tag):
    path = scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")
    S.write_samples(fx.samples(spark, sf), path)
    return path


@register("read_samples", _FILE_SQL + "SELECT sample_id, split, n_entities FROM k")
def read_samples(spark, sf):
    df = S.read_samples(spark, _written(spark, sf, "samples"))
    return df.select("sample_id", "split", F.size("entities").cast("bigint").alias("n_entities"))


@register("scan_train_val", _FILE_SQL + "SELECT sample_id, split, n_entities FROM k WHERE split <> 'test'")
def scan_train_val(spark, sf):
    df = S.scan_train_val(spark, _written(spark, sf, "samples"))
    return df.select("sample_id", "split", F.size("entities").cast("bigint").alias("n_entities"))


@register("export_splits", _FILE_SQL + "SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_entities) AS BIGINT) AS entities FROM k GROUP BY split")
def export_splits(spark, sf):
    path = scratch_path(spark, f"splits-{uuid.uuid4().hex}")
    back = S.export_splits(fx.samples(spark, sf, with_split=False).drop("split"), path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                     F.sum(F.size("entities")).cast("bigint").alias("entities"))


@register("generated_roundtrip", O.with_(_C) + """
SELECT CAST(length(d.text) AS BIGINT) AS n_chars, CAST(count(*) AS BIGINT) AS n_entities,
       CAST(sum(g.e - g.s) AS BIGINT) AS entity_chars
FROM docs d JOIN gold g USING (doc_id) GROUP BY d.doc_id, d.text""")
def generated_roundtrip(spark, sf):
    path = scratch_path(spark, f"generated-{uuid.uuid4().hex}")
    gen = ent.drop_unannotated(fx.samples(spark, sf, with_split=False))
    S.write_generated(gen, path)
    back = S.read_generated(spark, path)
    spans = F.aggregate(back["entities"], F.lit(0).cast("bigint"),
                        lambda acc, x: acc + (x["span"][1] - x["span"][0]))
    return back.select(F.length("text").cast("bigint").alias("n_chars"),
                       F.size("entities").cast("bigint").alias("n_entities"),
                       spans.alias("entity_chars"))
