"""Planning and verification queries: F11, F12, J6, W8, B4, B5, B6, F17, A2, J5, A9, B12."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave import oracle as O
from spanweave.catalog import register
from spanweave.operators import entities as ent
from spanweave.operators import parsing as P
from spanweave.operators import planning as PL
from spanweave.operators import verify as V
from spanweave.queries.parsing_q import _BASE as _REPLY_BASE, _EXTRACT
from spanweave.sources import fixtures as fx
from spanweave.sources import replies as RP

TOTAL, AVG = 2000, 4
_G = O.cand_ctes(garbled=True)
_BAD = "'[?☆〈〉]'"
_DIST = f"""dist AS (
  SELECT type, count(*) / sum(count(*)) OVER () AS ratio,
         CAST(count(DISTINCT name) FILTER (WHERE NOT regexp_matches(name, {_BAD})) AS BIGINT) AS unique_entities
  FROM gold GROUP BY type)"""
_PLAN = f"""p0 AS (
  SELECT type, ratio, unique_entities,
         CAST(greatest(1, floor(floor({TOTAL * AVG} * ratio) / {AVG})) AS BIGINT) AS target_samples FROM dist),
p1 AS (
  SELECT *, CAST(CASE WHEN target_samples >= 150 THEN least(30, unique_entities)
                      WHEN target_samples >= 80 THEN least(20, unique_entities)
                      WHEN target_samples >= 40 THEN least(15, unique_entities)
                      WHEN target_samples >= 15 THEN least(10, unique_entities)
                      WHEN target_samples >= 5 THEN least(5, unique_entities)
                      ELSE least(3, unique_entities) END AS BIGINT) AS top_n FROM p0),
plan AS (
  SELECT type, ratio, unique_entities, target_samples, top_n,
         CAST(greatest(1, floor(target_samples / greatest(1, top_n))) AS BIGINT) AS samples_per_entity,
         CAST(top_n * greatest(1, floor(target_samples / greatest(1, top_n))) AS BIGINT) AS estimated_samples FROM p1)"""
_RANKED = f"""rn AS (
  SELECT name, type, n, row_number() OVER (PARTITION BY type ORDER BY n DESC, name) AS rank FROM (
    SELECT name, type, count(*) AS n FROM gold WHERE NOT regexp_matches(name, {_BAD}) GROUP BY name, type))"""
_PT = """pt AS (
  SELECT r.type, r.name, r.rank, p.ratio, unnest(range(1, CAST(p.samples_per_entity AS BIGINT) + 1)) AS rep
  FROM rn r JOIN plan p ON r.type = p.type WHERE r.rank <= p.top_n)"""


def _ents(spark, sf):
    return ent.explode_entities(fx.samples(spark, sf, garbled=True, with_split=False))


def _plan(spark, sf):
    return PL.generation_plan(ent.entity_distribution(_ents(spark, sf), digits=None), TOTAL, AVG)


def _ranked(spark, sf, n=None):
    return ent.top_entities_per_type(_ents(spark, sf), n or PL.max_top_n(_plan(spark, sf)))


def _types(spark, sf):
    return ent.entity_distribution(_ents(spark, sf), digits=None)


@register("generation_plan", O.with_(_G, _DIST, _PLAN) + """
SELECT type, round(ratio, 6) AS ratio, unique_entities, target_samples, top_n, samples_per_entity, estimated_samples FROM plan""")
def generation_plan(spark, sf):
    p = _plan(spark, sf)
    return p.withColumn("ratio", F.round("ratio", 6))


_TARGET = f"CAST(greatest(1, floor(floor({TOTAL * AVG} * ratio) / {AVG})) AS BIGINT)"


def _branch_sql(target: str, top: str, each: str) -> str:
    return O.with_(_G, _DIST) + f"""
SELECT type, round(ratio, 6) AS ratio, unique_entities, CAST(target AS BIGINT) AS target_samples, CAST(tn AS BIGINT) AS top_n,
       CAST(each AS BIGINT) AS samples_per_entity, CAST(tn * each AS BIGINT) AS estimated_samples
FROM (SELECT *, {each} AS each FROM (SELECT *, {top} AS tn FROM (SELECT *, {target} AS target FROM dist)))"""


def _branch(spark, sf, **fixed):
    p = PL.generation_plan(ent.entity_distribution(_ents(spark, sf), digits=None), TOTAL, AVG, **fixed)
    return p.withColumn("ratio", F.round("ratio", 6))


@register("generation_plan_fixed", _branch_sql("least(5, unique_entities) * 10", "least(5, unique_entities)", "10"))
def generation_plan_fixed(spark, sf):
    return _branch(spark, sf, top_n=5, samples_per_entity=10)


@register("generation_plan_names", _branch_sql(_TARGET, "least(5, unique_entities)", "greatest(1, floor(target / greatest(1, tn)))"))
def generation_plan_names(spark, sf):
    return _branch(spark, sf, top_n=5)


@register("generation_plan_repeats", _branch_sql(_TARGET, "least(greatest(1, floor(target / 10)), unique_entities)", "10"))
def generation_plan_repeats(spark, sf):
    return _branch(spark, sf, samples_per_entity=10)


@register("plan_to_tasks", O.with_(_G, _DIST, _PLAN, _RANKED, _PT) +
          "SELECT type, name, CAST(rank AS BIGINT) AS rank, CAST(rep AS BIGINT) AS rep FROM pt")
def plan_to_tasks(spark, sf):
    t = PL.plan_to_tasks(_plan(spark, sf), _ranked(spark, sf))
    return t.select("type", "name", F.col("rank").cast("bigint"), F.col("rep").cast("bigint"))


@register("tasks_balanced", O.with_(_G, _DIST, _PLAN, _RANKED, _PT) + """
SELECT CAST(row_number() OVER (ORDER BY ratio DESC, type, rank, rep) - 1 AS BIGINT) AS task_id,
       type AS primary_type, name FROM pt""")
def tasks_balanced(spark, sf):
    t = PL.tasks_balanced(_plan(spark, sf), _ranked(spark, sf))
    return t.select("task_id", "primary_type", F.col("targets")[0]["name"].alias("name"))


@register("request_ids", O.with_(_G, _DIST, _PLAN, _RANKED, _PT, """tb AS (
  SELECT CAST(row_number() OVER (ORDER BY ratio DESC, type, rank, rep) - 1 AS BIGINT) AS task_id FROM pt)""") + """
SELECT task_id, 'req_' || lpad(CAST(task_id AS VARCHAR), 6, '0') AS custom_id,
       CAST(floor(task_id / 10) AS BIGINT) AS chunk, CAST(ceil((SELECT count(*) FROM tb) / 10) AS BIGINT) AS n_chunks
FROM tb""")
def request_ids(spark, sf):
    return PL.request_ids(PL.tasks_balanced(_plan(spark, sf), _ranked(spark, sf)), 10)


_TOP = f"""f AS (SELECT name, type, count(*) AS n FROM gold WHERE NOT regexp_matches(name, {_BAD}) GROUP BY name, type),
top AS (
  SELECT name, type, n FROM (SELECT name, type, n, row_number() OVER (PARTITION BY type ORDER BY n DESC, name) AS rk FROM f)
  ORDER BY (rk = 1) DESC, n DESC, type, name LIMIT 20),
alloc AS (SELECT name, type, n, CAST(greatest(1, floor({TOTAL} * (n / (SELECT sum(n) FROM top)))) AS BIGINT) AS num_samples FROM top)"""


@register("proportional_alloc", O.with_(_G, _TOP) + "SELECT name, type, CAST(n AS BIGINT) AS n, num_samples FROM alloc")
def proportional_alloc(spark, sf):
    top = ent.global_top_entities(_ents(spark, sf), 20)
    return PL.proportional_alloc(top, TOTAL).select("name", "type", "n", "num_samples")


@register("tasks_topn", O.with_(_G, _TOP) + """
SELECT CAST(row_number() OVER (ORDER BY n DESC, type, name, rep) - 1 AS BIGINT) AS task_id, type AS primary_type, name
FROM (SELECT name, type, n, unnest(range(1, num_samples + 1)) AS rep FROM alloc)""")
def tasks_topn(spark, sf):
    t = PL.tasks_topn(ent.global_top_entities(_ents(spark, sf), 20), TOTAL)
    return t.select("task_id", "primary_type", F.col("targets")[0]["name"].alias("name"))


@register("round_robin_types", O.with_(_G) + """
SELECT CAST(i AS BIGINT) AS task_id, ts[(i % len(ts)) + 1] AS primary_type
FROM (SELECT list_sort(list(DISTINCT type)) AS ts FROM gold), range(0, 100) r(i)""")
def round_robin_types(spark, sf):
    names = _ranked(spark, sf, 1000)
    t = PL.tasks_uniform_multi(spark, names, 100, entities_per_sample=1, types=_types(spark, sf))
    return t.where(F.col("slot") == 0).select("task_id", F.col("type").alias("primary_type"))


@register("tasks_uniform_multi", O.with_(_G, """rk AS (
  SELECT name, type, row_number() OVER (PARTITION BY type ORDER BY n DESC, name) AS rank FROM (
    SELECT name, type, count(*) AS n FROM gold WHERE NOT regexp_matches(name, '[?☆〈〉]') GROUP BY name, type)),
cnt AS (SELECT type, max(rank) AS cnt FROM rk WHERE rank <= 1000 GROUP BY type)""", """tl AS (SELECT list_sort(list(DISTINCT type)) AS ts FROM gold),
tasks AS (SELECT CAST(i AS BIGINT) AS task_id, ts, ts[(i % len(ts)) + 1] AS primary_type FROM tl, range(0, 200) r(i)),
oth AS (
  SELECT task_id, type, row_number() OVER (PARTITION BY task_id ORDER BY md5('42:' || CAST(task_id AS VARCHAR) || ':' || type), type) AS slot
  FROM (SELECT task_id, primary_type, unnest(ts) AS type FROM tasks) WHERE type <> primary_type),
slots AS (SELECT task_id, 0 AS slot, primary_type AS type FROM tasks
          UNION ALL SELECT task_id, slot, type FROM oth WHERE slot <= 2),
pick AS (
  SELECT s.task_id, s.slot, s.type,
         CAST(('0x' || substr(md5('42:' || CAST(s.task_id AS VARCHAR) || ':' || s.type), 1, 8)) AS BIGINT) % c.cnt + 1 AS rank
  FROM slots s JOIN cnt c USING (type))""") + """
SELECT p.task_id, CAST(p.slot AS BIGINT) AS slot, p.type, r.name FROM pick p JOIN rk r ON p.type = r.type AND p.rank = r.rank""")
def tasks_uniform_multi(spark, sf):
    return PL.tasks_uniform_multi(spark, _ranked(spark, sf, 1000), 200, entities_per_sample=3, types=_types(spark, sf))


# Verification: the real corpus (train + validation) against the generated
# set, i.e. the repaired entities extracted from annotation replies.
_REAL = """real AS (
  SELECT type, count(*) / sum(count(*)) OVER () AS ratio FROM gold JOIN splits USING (doc_id)
  WHERE split IN ('train', 'validation') GROUP BY type)"""
_GEN = """gen AS (SELECT type, count(*) AS n, count(*) / sum(count(*)) OVER () AS ratio FROM rep
  WHERE outcome IN ('kept', 'moved') GROUP BY type)"""
_VBASE = _REPLY_BASE + "," + O.split_cte() + _EXTRACT + ",\n" + _REAL + ",\n" + _GEN + """,
dd AS (SELECT r.type, r.ratio AS real_ratio, CAST(coalesce(g.n, 0) AS BIGINT) AS gen_n,
              coalesce(g.ratio, 0.0) AS gen_ratio, coalesce(g.ratio, 0.0) - r.ratio AS diff
       FROM real r LEFT JOIN gen g USING (type))
"""


def _generated(spark, sf):
    x = P.extract_annotation(RP.responses(spark, sf), "reply")
    return (x.where(F.col("entities").isNotNull())
             .select(F.explode(P.repaired_only(F.col("entities"))).alias("e")).select("e.type", "e.name"))


def _real(spark, sf):
    s = fx.samples(spark, sf).where(F.col("split").isin("train", "validation"))
    return ent.entity_distribution(ent.explode_entities(s), digits=None)


@register("generated_distribution", _VBASE + "SELECT type, CAST(n AS BIGINT) AS n, round(ratio, 6) AS ratio FROM gen")
def generated_distribution(spark, sf):
    return V.generated_distribution(_generated(spark, sf)).withColumn("ratio", F.round("ratio", 6))


@register("distribution_diff", _VBASE + """
SELECT type, round(real_ratio, 6) AS real_ratio, gen_n, round(gen_ratio, 6) AS gen_ratio, round(diff, 6) AS diff FROM dd""")
def distribution_diff(spark, sf):
    d = V.distribution_diff(_real(spark, sf), _generated(spark, sf))
    return d.select("type", *[F.round(c, 6).alias(c) for c in ("real_ratio",)], "gen_n",
                    F.round("gen_ratio", 6).alias("gen_ratio"), F.round("diff", 6).alias("diff"))


_MAD_SQL = """SELECT round(coalesce(avg(abs(diff)), 0.0), 6) AS mad,
       CASE WHEN coalesce(avg(abs(diff)), 0.0) < 0.02 THEN 'good' WHEN coalesce(avg(abs(diff)), 0.0) < 0.05 THEN 'fair' ELSE 'poor' END AS verdict
FROM dd"""


@register("distribution_mad", _VBASE + _MAD_SQL)
def distribution_mad(spark, sf):
    m = V.distribution_mad(V.distribution_diff(_real(spark, sf), _generated(spark, sf)))
    return m.select(F.round("mad", 6).alias("mad"), "verdict")


@register("verify_generated", _VBASE + """
SELECT d.type, round(d.real_ratio, 6) AS real_ratio, round(d.gen_ratio, 6) AS gen_ratio, round(d.diff, 6) AS diff, m.mad, m.verdict
FROM dd d CROSS JOIN (""" + _MAD_SQL + ") m")
def verify_generated(spark, sf):
    from spanweave.plans.generation import verify_generated as vg
    return vg(_real(spark, sf), _generated(spark, sf))
