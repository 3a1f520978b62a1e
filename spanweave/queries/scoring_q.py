"""Scoring queries (J1, J2, U2, A6, A7, A8, A21) over the derived gold/pred."""

from __future__ import annotations

from spanweave import oracle as O
from spanweave.catalog import register
from spanweave.operators import scoring
from spanweave.sources import fixtures as fx

_BASE = O.cand_ctes()


@register("span_match", O.with_(_BASE, O.MATCH_CTE) + "SELECT doc_id, type, s, e, outcome FROM m")
def span_match(spark, sf):
    return scoring.span_match(fx.gold_rows(spark, sf), fx.pred_rows(spark, sf))


_PRF_SQL = O.with_(_BASE, O.MATCH_CTE, O.TYPE_COUNTS_CTE) + f"""
SELECT type, tp, n_pred, support,
       round({O.ratio('tp', 'n_pred')}, 6) AS precision,
       round({O.ratio('tp', 'support')}, 6) AS recall,
       round({O.ratio('2 * tp', 'n_pred + support')}, 6) AS f1
FROM tc"""


@register("prf_by_type", _PRF_SQL)
def prf_by_type(spark, sf):
    return scoring.prf_by_type(scoring.match_arrays(fx.annotated(spark, sf)))


_OVERALL_SQL = O.with_(_BASE, O.MATCH_CTE, O.TYPE_COUNTS_CTE, f"""per AS (
  SELECT *, {O.ratio('tp', 'n_pred')} AS p, {O.ratio('tp', 'support')} AS r,
         {O.ratio('2 * tp', 'n_pred + support')} AS f FROM tc)""", """t AS (
  SELECT CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n_pred), 0) AS BIGINT) AS n_pred,
         CAST(coalesce(sum(support), 0) AS BIGINT) AS support,
         coalesce(avg(p), 0.0) AS mp, coalesce(avg(r), 0.0) AS mr, coalesce(avg(f), 0.0) AS mf,
         sum(p * support) AS wp, sum(r * support) AS wr, sum(f * support) AS wf FROM per)""") + f"""
SELECT 'micro avg' AS avg_type, round({O.ratio('tp', 'n_pred')}, 6) AS precision,
       round({O.ratio('tp', 'support')}, 6) AS recall,
       round({O.ratio('2 * tp', 'n_pred + support')}, 6) AS f1, support FROM t
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), support FROM t
UNION ALL SELECT 'weighted avg', round({O.ratio('wp', 'support')}, 6), round({O.ratio('wr', 'support')}, 6),
       round({O.ratio('wf', 'support')}, 6), support FROM t"""


@register("prf_overall", _OVERALL_SQL)
def prf_overall(spark, sf):
    return scoring.prf_overall(scoring.match_arrays(fx.annotated(spark, sf)))


@register("metrics", _PRF_SQL.replace("SELECT type, tp, n_pred, support,", "SELECT 'type' AS level, type AS name, support,")
          + "\nUNION ALL SELECT 'average', avg_type, support, precision, recall, f1 FROM (" + _OVERALL_SQL + ")")
def metrics(spark, sf):
    return scoring.metrics(fx.gold_rows(spark, sf), fx.pred_rows(spark, sf))


@register("type_confusion", O.with_(_BASE) + """
SELECT coalesce(g.type, 'NONE') AS gold_type, coalesce(p.type, 'NONE') AS pred_type, count(*) AS n
FROM (SELECT DISTINCT doc_id, s, e, type FROM gold) g
FULL OUTER JOIN (SELECT DISTINCT doc_id, s, e, type FROM pred) p
  ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e
GROUP BY 1, 2""")
def type_confusion(spark, sf):
    return scoring.type_confusion(fx.gold_rows(spark, sf), fx.pred_rows(spark, sf))


# Surface sets use the predicted surface text of the span (the annotator
# writes the text it saw, so a shortened span has a shortened surface).
_SURF_CTES = O.with_(_BASE, """ps AS (
  SELECT p.doc_id, p.type, substr(d.text, CAST(p.s + 1 AS BIGINT), CAST(p.e - p.s AS BIGINT)) AS surface
  FROM pred p JOIN docs d USING (doc_id))""", """sets AS (
  SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.type, p.type) AS type,
         coalesce(g.surface, p.surface) AS surface,
         CASE WHEN g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL THEN 'tp'
              WHEN g.doc_id IS NOT NULL THEN 'fn' ELSE 'fp' END AS outcome
  FROM (SELECT DISTINCT doc_id, type, name AS surface FROM gold) g
  FULL OUTER JOIN (SELECT DISTINCT doc_id, type, surface FROM ps) p
    ON g.doc_id = p.doc_id AND g.type = p.type AND g.surface = p.surface)""")


def _surface_sets(spark, sf):
    from pyspark.sql import functions as F
    a = fx.annotated(spark, sf)
    gold = a.select("doc_id", F.inline("gold")).select("doc_id", "type", "name")
    pred = (a.select("doc_id", "text", F.inline("pred"))
             .select("doc_id", "type", F.expr("substring(text, s + 1, e - s)").alias("surface")))
    return scoring.surface_sets(gold, pred, gold_surface="name", pred_surface="surface")


@register("surface_match", _SURF_CTES + "SELECT doc_id, type, surface, outcome FROM sets")
def surface_match(spark, sf):
    return _surface_sets(spark, sf)


@register("surface_set_ops", _SURF_CTES + """
SELECT CASE outcome WHEN 'tp' THEN 'true & pred' WHEN 'fp' THEN 'pred - true' ELSE 'true - pred' END AS set_op,
       CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS samples
FROM sets GROUP BY 1""")
def surface_set_ops(spark, sf):
    from pyspark.sql import functions as F
    s = _surface_sets(spark, sf)
    op = (F.when(F.col("outcome") == "tp", "true & pred")
           .when(F.col("outcome") == "fp", "pred - true").otherwise("true - pred"))
    return s.groupBy(op.alias("set_op")).agg(F.count(F.lit(1)).alias("n"),
                                             F.count_distinct("doc_id").alias("samples"))


@register("surface_prf", _SURF_CTES + f"""
SELECT round({O.ratio('tp', 'tp + fp')}, 6) AS precision, round({O.ratio('tp', 'tp + fn')}, 6) AS recall,
       round({O.ratio('2 * tp', '2 * tp + fp + fn')}, 6) AS f1, tp, fp, fn
FROM (SELECT CAST(count(*) FILTER (WHERE outcome = 'tp') AS BIGINT) AS tp,
             CAST(count(*) FILTER (WHERE outcome = 'fp') AS BIGINT) AS fp,
             CAST(count(*) FILTER (WHERE outcome = 'fn') AS BIGINT) AS fn FROM sets)""")
def surface_prf(spark, sf):
    return scoring.surface_prf(_surface_sets(spark, sf))
