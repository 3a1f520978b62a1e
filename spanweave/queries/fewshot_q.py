"""Few-shot selection queries: W2, L7, L8."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave import oracle as O
from spanweave.catalog import register
from spanweave.operators import fewshot as FS
from spanweave.sources import fixtures as fx

_C = O.cand_ctes()


@register("running_type_score", O.with_(_C, """pt AS (SELECT doc_id, type, count(*) AS c FROM gold GROUP BY doc_id, type)""") + """
SELECT doc_id AS sample_id, CAST(sum(r) AS BIGINT) AS score FROM (
  SELECT doc_id, sum(c) OVER (PARTITION BY type ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS r FROM pt)
GROUP BY doc_id""")
def running_type_score(spark, sf):
    return FS.running_type_score(fx.samples(spark, sf, with_split=False))


@register("few_shot_diverse", O.with_(_C, """ts AS (
  SELECT d.doc_id, coalesce(string_agg(DISTINCT g.type, ',' ORDER BY g.type), '') AS ts_key
  FROM docs d LEFT JOIN gold g USING (doc_id) GROUP BY d.doc_id)""") + """
SELECT doc_id AS sample_id, ts_key, CAST(rnd AS BIGINT) AS round FROM (
  SELECT doc_id, ts_key, md5('42:' || ts_key) AS g,
         row_number() OVER (PARTITION BY ts_key ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rnd FROM ts)
ORDER BY rnd, g, ts_key LIMIT 12""")
def few_shot_diverse(spark, sf):
    d = FS.few_shot_diverse(fx.samples(spark, sf, with_split=False), 12)
    return d.select("sample_id", "ts_key", F.col("round").cast("bigint"))


_PICK = "list_filter(l, lambda y: list_contains(y.ts, x.c[1]) AND NOT list_contains(acc.i, y.id))[1]"


@register("few_shot_stratified", O.with_(_C, """pt AS (SELECT doc_id, type, count(*) AS c FROM gold GROUP BY doc_id, type)""", """sc AS (
  SELECT doc_id, sum(r) AS score, list_sort(list(type)) AS ts FROM (
    SELECT doc_id, type, sum(c) OVER (PARTITION BY type ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS r FROM pt) GROUP BY doc_id)""", """cl AS (
  SELECT list({'ts': ts, 'id': doc_id} ORDER BY score DESC, doc_id) AS l FROM (
    SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, doc_id) AS rk FROM sc) WHERE rk = 1)""", """fr AS (
  SELECT list({'c': [type], 'i': []::BIGINT[]} ORDER BY n DESC, type) AS f FROM (SELECT type, sum(c) AS n FROM pt GROUP BY type))""", f"""cover AS (
  SELECT unnest(list_reduce(f, lambda acc, x: CASE WHEN list_contains(acc.c, x.c[1]) OR len(acc.i) >= 8 OR {_PICK} IS NULL THEN acc
    ELSE {{'c': acc.c || {_PICK}.ts, 'i': acc.i || [{_PICK}.id]}} END, {{'c': []::VARCHAR[], 'i': []::BIGINT[]}}).i) AS doc_id FROM fr, cl)""") + """
SELECT doc_id AS sample_id, 'cover' AS phase FROM cover
UNION ALL SELECT doc_id, 'fill' FROM (
  SELECT doc_id FROM sc WHERE doc_id NOT IN (SELECT doc_id FROM cover) ORDER BY score DESC, doc_id
  LIMIT (SELECT 8 - count(*) FROM cover))""")
def few_shot_stratified(spark, sf):
    s = FS.few_shot_stratified(fx.samples(spark, sf, with_split=False), 8)
    return s.select("sample_id", "phase")


@register("few_shot_by_name", O.with_(_C, """h AS (SELECT doc_id, md5('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents)""") + """
SELECT doc_id AS sample_id FROM h ORDER BY h, doc_id LIMIT 7""")
def few_shot_by_name(spark, sf):
    """An unknown strategy falls back to the random one."""
    s = fx.samples(spark, sf, with_split=False)
    return FS.select_few_shot(s, 7, "no such strategy").select("sample_id")
