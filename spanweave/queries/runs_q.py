"""Run leaderboard queries over the derived run results."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave import oracle as O
from spanweave.catalog import register
from spanweave.functions import models as MD
from spanweave.operators import runs as RN
from spanweave.sources import runs as RS



def _rules(key: str, name: str, crf: str) -> str:
    """The name rules (F9, F10) as SQL columns."""
    k, n = f"lower({key})", f"lower({name})"
    llama = f"regexp_matches({k} || ' ' || {n}, 'llama|rinna|gpt-neox|elyza')"
    bilstm = f"({k} LIKE '%bilstm%' OR {n} LIKE '%bilstm%')"
    remote = f"regexp_matches({k}, 'chatgpt|claude|remote')"
    large = f"({n} LIKE '%large%' OR {k} LIKE '%large%')"
    return f"""({crf} OR {k} LIKE '%\\_crf%' ESCAPE '\\') AS use_crf, {large} AS is_large,
         CASE WHEN {bilstm} THEN 'bilstm' WHEN {remote} THEN 'remote_llm' WHEN {llama} THEN 'llama' ELSE 'bert' END AS model_type,
         {key} || CASE WHEN {large} AND {k} NOT LIKE '%large%' THEN '-large' ELSE '' END
               || CASE WHEN {crf} AND NOT regexp_matches({k}, '[_-]crf') THEN '-crf' ELSE '' END
               || CASE WHEN {bilstm} AND {k} NOT LIKE '%bilstm%' THEN ' [BiLSTM]'
                       WHEN {llama} AND NOT regexp_matches({k}, 'llama|rinna') THEN ' [LLM]'
                       WHEN {remote} AND {k} NOT LIKE '%remote%' THEN ' [API]' ELSE '' END AS display_name,
         CASE WHEN {n} LIKE '%bert%' THEN
                CASE WHEN {n} LIKE '%deberta%' THEN 'deberta' WHEN {n} LIKE '%roberta%' THEN 'roberta'
                     WHEN {n} LIKE '%albert%' THEN 'albert' ELSE 'bert' END
              WHEN {n} LIKE '%xlnet%' THEN 'xlnet' WHEN {n} LIKE '%luke%' THEN 'luke' WHEN {n} LIKE '%bilstm%' THEN 'bilstm'
              WHEN regexp_matches({n}, 'rinna|gpt-neox') THEN 'rinna' WHEN regexp_matches({n}, 'elyza|llama') THEN 'llama'
              WHEN regexp_matches({n}, 'gpt-4|chatgpt') THEN 'chatgpt' WHEN {n} LIKE '%claude%' THEN 'claude' WHEN {n} LIKE '%gpt%' THEN 'gpt'
              ELSE substr(replace(string_split({name}, '/')[-1], '-', '_'), 1, 20) END AS family"""


_C = O.cand_ctes()
_RES = O.with_(_C, f"""runs AS (SELECT * FROM (VALUES {RS.runs_sql_values()}) t(model_key, model_name, drop_below, run_order, hp_crf))""", """rg AS (
  SELECT r.model_key, r.drop_below, g.doc_id, g.type, g.s, g.e,
         md5(r.model_key || ':' || CAST(g.doc_id AS VARCHAR) || ':' || CAST(g.s AS VARCHAR)) AS h
  FROM gold g CROSS JOIN runs r)""", """rp AS (
  SELECT model_key, doc_id, CASE WHEN substr(h, 3, 1) = '0' THEN 'person' ELSE type END AS type, s, e
  FROM rg WHERE substr(h, 1, 2) >= drop_below)""", """rm AS (
  SELECT coalesce(g.model_key, p.model_key) AS model_key, coalesce(g.type, p.type) AS type,
         CASE WHEN g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL THEN 'tp' WHEN g.doc_id IS NOT NULL THEN 'fn' ELSE 'fp' END AS outcome
  FROM (SELECT DISTINCT model_key, doc_id, type, s, e FROM rg) g
  FULL OUTER JOIN (SELECT DISTINCT model_key, doc_id, type, s, e FROM rp) p
    ON g.model_key = p.model_key AND g.doc_id = p.doc_id AND g.type = p.type AND g.s = p.s AND g.e = p.e)""", """rtc AS (
  SELECT model_key, type, count(*) FILTER (WHERE outcome = 'tp') AS tp,
         count(*) FILTER (WHERE outcome IN ('tp', 'fp')) AS n_pred, count(*) FILTER (WHERE outcome IN ('tp', 'fn')) AS support
  FROM rm GROUP BY model_key, type)""", f"""res AS (
  SELECT r.model_key, r.model_name || '-v' || CAST(t.tp % 7 AS VARCHAR) AS model_name, r.run_order, r.hp_crf,
         CASE WHEN r.model_key IN ('bilstm_crf') THEN 'failed' ELSE 'success' END AS status, t.n_pred % 9 + 1 AS day,
         CAST(t.n_pred AS DOUBLE) / 8 + (t.support - t.tp) % 1024 AS training_time,
         CAST(floor((SELECT count(*) FROM documents) * 0.8::DOUBLE) AS BIGINT) AS n_train,
         CAST((SELECT count(*) FROM documents) - floor((SELECT count(*) FROM documents) * 0.8::DOUBLE)
              - floor((SELECT count(*) FROM documents) * 0.1::DOUBLE) AS BIGINT) AS n_test,
         {O.ratio('t.tp', 't.n_pred')} AS precision, {O.ratio('t.tp', 't.support')} AS recall,
         {O.ratio('2 * t.tp', 't.n_pred + t.support')} AS f1, {O.ratio('t.tp', 't.n_pred + t.support - t.tp')} AS accuracy
  FROM runs r JOIN (SELECT model_key, sum(tp) AS tp, sum(n_pred) AS n_pred, sum(support) AS support FROM rtc GROUP BY model_key) t
    USING (model_key))""", f"""ok AS (SELECT * FROM res WHERE status = 'success')""", f"""rt AS (
  SELECT c.model_key, o.run_order, c.type, {O.ratio('tp', 'n_pred')} AS precision, {O.ratio('tp', 'support')} AS recall,
         {O.ratio('2 * tp', 'n_pred + support')} AS f1, CAST(support AS BIGINT) AS support
  FROM rtc c JOIN ok o USING (model_key))""", "fl AS (SELECT *, " + _rules("model_key", "model_name", "hp_crf") + " FROM res)")
_R6 = "round({c}, 6) AS {c}"


def _ok(spark, sf):
    return RN.successful_runs(RS.results(spark, sf))


def _r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


@register("successful_runs", _RES + "SELECT model_key, model_name, round(f1, 6) AS f1 FROM ok")
def successful_runs(spark, sf):
    return _ok(spark, sf).select("model_key", "model_name", F.round(RN.metric("f1"), 6).alias("f1"))


@register("run_ranking", _RES + """
SELECT model_key, round(f1, 6) AS f1, CAST(row_number() OVER (ORDER BY f1 DESC, run_order) AS BIGINT) AS rank FROM ok""")
def run_ranking(spark, sf):
    r = RN.run_ranking(_ok(spark, sf))
    return r.select("model_key", F.round(RN.metric("f1"), 6).alias("f1"), F.col("rank").cast("bigint"))


@register("best_worst_run", _RES + """
SELECT (SELECT model_key FROM ok ORDER BY f1 DESC, run_order LIMIT 1) AS best,
       (SELECT model_key FROM ok ORDER BY f1 ASC, run_order LIMIT 1) AS worst""")
def best_worst_run(spark, sf):
    return RN.best_worst_run(_ok(spark, sf))


@register("type_leaderboard", _RES + """
SELECT type, model_key, round(f1, 6) AS f1, CAST(row_number() OVER (PARTITION BY type ORDER BY f1 DESC, run_order) AS BIGINT) AS rank FROM rt""")
def type_leaderboard(spark, sf):
    t = RN.type_leaderboard(_ok(spark, sf))
    return t.select("type", "model_key", F.round("f1", 6).alias("f1"), F.col("rank").cast("bigint"))


@register("best_run_per_type", _RES + """
SELECT type, model_key, round(f1, 6) AS f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY type ORDER BY f1 DESC, run_order) AS rk FROM rt) WHERE rk = 1""")
def best_run_per_type(spark, sf):
    b = RN.best_run_per_type(_ok(spark, sf))
    return b.select("type", "model_key", F.round("f1", 6).alias("f1"))


@register("top_bottom_types", _RES + """
SELECT 'top' AS which, type, round(f1, 6) AS f1 FROM (SELECT * FROM rt WHERE model_key = 'bert' ORDER BY f1 DESC, type LIMIT 2)
UNION ALL SELECT 'bottom', type, round(f1, 6) FROM (SELECT * FROM rt WHERE model_key = 'bert' ORDER BY f1 ASC, type LIMIT 2)""")
def top_bottom_types(spark, sf):
    t = RN.top_bottom_types(_ok(spark, sf), "bert", 2)
    return t.select("which", "type", F.round("f1", 6).alias("f1"))


@register("summary_table", _RES + """
SELECT model_key, display_name, model_name, model_type, use_crf, is_large, family,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, training_time,
       n_train AS num_train_samples, n_test AS num_test_samples
FROM fl WHERE status = 'success'""")
def summary_table(spark, sf):
    s = RN.summary_table(_ok(spark, sf))
    return s.select("model_key", "display_name", "model_name", "model_type", "use_crf", "is_large", "family",
                    *_r6("precision", "recall", "f1"), "training_time", "num_train_samples", "num_test_samples")


@register("crf_split_topk", _RES + """
SELECT use_crf, model_key, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY use_crf ORDER BY f1 DESC, run_order) AS rank FROM fl WHERE status = 'success')
WHERE rank <= 6""")
def crf_split_topk(spark, sf):
    c = RN.crf_split_topk(_ok(spark, sf), 6)
    return c.select("use_crf", "model_key", F.col("rank").cast("bigint"))


@register("top_runs", _RES + "SELECT use_crf, model_key FROM fl WHERE status = 'success' ORDER BY f1 DESC, run_order LIMIT 5")
def top_runs(spark, sf):
    return RN.top_runs(_ok(spark, sf), 5).select("use_crf", "model_key")


@register("time_ranking", _RES + """
SELECT model_key, training_time, CAST(row_number() OVER (ORDER BY training_time, run_order) AS BIGINT) AS rank FROM ok""")
def time_ranking(spark, sf):
    return RN.time_ranking(_ok(spark, sf)).select("model_key", "training_time", F.col("rank").cast("bigint"))


_NAMES = f"""WITH h AS (
  SELECT doc_id, regexp_extract(coalesce(text, ''), '^[A-Za-z]*') AS word, md5('name:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
m AS (SELECT [{", ".join(f"'{m}'" for m in RS.NAME_MARKS)}] AS marks),
named AS (
  SELECT doc_id, word || marks[CAST('0x' || substr(h, 1, 2) AS INTEGER) % {len(RS.NAME_MARKS)} + 1] AS model_key, substr(h, 7, 1) < '8' AS hp_crf,
         'org/' || marks[CAST('0x' || substr(h, 3, 2) AS INTEGER) % {len(RS.NAME_MARKS)} + 1] || '-' || word
                || marks[CAST('0x' || substr(h, 5, 2) AS INTEGER) % {len(RS.NAME_MARKS)} + 1] AS model_name FROM h, m)
SELECT """ + "{cols} FROM (SELECT *, " + _rules("model_key", "model_name", "hp_crf") + " FROM named)"


@register("model_family", _NAMES.replace("{cols}", "doc_id, model_name, family"))
def model_family(spark, sf):
    n = RS.model_names(spark, sf)
    return n.select("doc_id", "model_name", MD.model_family(F.col("model_name")).alias("family"))


@register("run_flags", _NAMES.replace("{cols}", "doc_id, model_key, use_crf, is_large, model_type, display_name"))
def run_flags(spark, sf):
    n = RS.model_names(spark, sf)
    f = n.withColumn("flags", MD.run_flags(F.col("model_key"), F.col("model_name"), F.col("use_crf")))
    return f.select("doc_id", "model_key", "flags.use_crf", "flags.is_large", "flags.model_type", "flags.display_name")


_CMP = _RES + """, a AS (SELECT * FROM res WHERE model_key = 'bert'), b AS (SELECT * FROM res WHERE model_key = 'bert_crf'),
cmp AS (
  SELECT 'precision' AS metric, a.precision AS va, b.precision AS vb FROM a, b
  UNION ALL SELECT 'recall', a.recall, b.recall FROM a, b
  UNION ALL SELECT 'f1', a.f1, b.f1 FROM a, b
  UNION ALL SELECT 'training_time', a.training_time, b.training_time FROM a, b)
SELECT metric, round(va, 6) AS value_a, round(vb, 6) AS value_b, round(va - vb, 6) AS diff,
       round(CASE WHEN vb > 0 THEN (va - vb) / vb * 100 ELSE 0.0 END, 6) AS improvement_pct FROM cmp"""


@register("compare_runs", _CMP)
def compare_runs(spark, sf):
    c = RN.compare_runs(RS.results(spark, sf), "bert", "bert_crf")
    return c.select("metric", *_r6("value_a", "value_b", "diff", "improvement_pct"))


@register("improvement_pct", _CMP.replace(
    "SELECT metric, round(va, 6) AS value_a, round(vb, 6) AS value_b, round(va - vb, 6) AS diff,\n       round(",
    "SELECT metric, round("))
def improvement_pct(spark, sf):
    c = RN.compare_runs(RS.results(spark, sf), "bert", "bert_crf")
    return c.select("metric", F.round("improvement_pct", 6).alias("improvement_pct"))


_OK_KEYS = [k for k, *_ in RS.RUNS if k not in RS.FAILED]


@register("radar_matrix", _RES + "SELECT type, " + ", ".join(
    f"round(coalesce(max(f1) FILTER (WHERE model_key = '{k}'), 0.0), 6) AS \"{k}\"" for k in _OK_KEYS) + " FROM rt GROUP BY type")
def radar_matrix(spark, sf):
    r = RN.radar_matrix(_ok(spark, sf), _OK_KEYS)
    return r.select("type", *[F.round(F.col(f"`{k}`"), 6).alias(k) for k in _OK_KEYS])


@register("all_types", _RES + "SELECT DISTINCT type FROM rt")
def all_types(spark, sf):
    return RN.all_types(_ok(spark, sf))
