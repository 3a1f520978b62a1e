"""Tag-level queries: F5, W9, W3, A5, F15, S9, P6, P5."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave import oracle as O
from spanweave.catalog import register
from spanweave.operators import tagging as tg
from spanweave.sources import fixtures as fx
from spanweave.sources.tables import explode_rows, keep_if

_C = O.cand_ctes()
# Vocabulary of the earthquake dataset; 'work' is outside it.
KNOWN = ("location", "damage", "person", "datetime")

_CHARS = "chars AS (SELECT doc_id, unnest(range(0, length(text))) AS i FROM docs)"
_GTAG = """gtag AS (
  SELECT c.doc_id, c.i, coalesce(CASE WHEN g.s = c.i THEN 'B-' ELSE 'I-' END || g.type, 'O') AS tag
  FROM chars c LEFT JOIN gold g ON c.doc_id = g.doc_id AND c.i >= g.s AND c.i < g.e)"""
_PTAG = """ptag AS (
  SELECT c.doc_id, c.i, coalesce(CASE WHEN p.s = c.i THEN 'B-' ELSE 'I-' END || p.type, 'O') AS tag
  FROM chars c LEFT JOIN pred p ON c.doc_id = p.doc_id AND c.i >= p.s AND c.i < p.e)"""
# gold followed by pred: a predicted span overwrites gold where they overlap
_MTAG = """mtag AS (
  SELECT g.doc_id, g.i, CASE WHEN p.tag <> 'O' THEN p.tag
                            WHEN g.tag <> 'O' AND p.tag = 'O' THEN
                              CASE WHEN g.tag LIKE 'B-%' THEN g.tag ELSE g.tag END
                            ELSE 'O' END AS tag
  FROM gtag g JOIN ptag p ON g.doc_id = p.doc_id AND g.i = p.i)"""


def _tag_summary_sql(tag_cte: str) -> str:
    return f"""
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tags,
       CAST(count(*) FILTER (WHERE tag LIKE 'B-%') AS BIGINT) AS n_b,
       CAST(count(*) FILTER (WHERE tag LIKE 'I-%') AS BIGINT) AS n_i,
       md5(string_agg(tag, ' ' ORDER BY i)) AS tags_md5
FROM {tag_cte} GROUP BY doc_id"""


def _with_tags(spark, sf):
    a = fx.annotated(spark, sf)
    g = tg.spans_to_entities("gold")
    p = tg.spans_to_entities("pred")
    return a.select(
        "doc_id", "text",
        tg.bio_tags_expr(g, "length(text)").alias("gold_tags"),
        tg.bio_tags_expr(p, "length(text)").alias("pred_tags"),
        tg.bio_tags_expr(f"concat({g}, {p})", "length(text)").alias("mix_tags"))


def _summary(df, col):
    return keep_if(df, F.size(col) > 0).select(
        "doc_id", F.size(col).cast("bigint").alias("n_tags"),
        F.size(F.filter(col, lambda t: t.startswith("B-"))).cast("bigint").alias("n_b"),
        F.size(F.filter(col, lambda t: t.startswith("I-"))).cast("bigint").alias("n_i"),
        F.md5(F.array_join(col, " ")).alias("tags_md5"))


@register("bio_tags", O.with_(_C, _CHARS, _GTAG) + _tag_summary_sql("gtag"))
def bio_tags(spark, sf):
    return _summary(_with_tags(spark, sf), "gold_tags")


@register("overlap_last_wins", O.with_(_C, _CHARS, _GTAG, _PTAG, _MTAG) + _tag_summary_sql("mtag"))
def overlap_last_wins(spark, sf):
    return _summary(_with_tags(spark, sf), "mix_tags")


@register("bio_to_spans", O.with_(_C, _CHARS, _GTAG, _PTAG, _MTAG, """st AS (
  SELECT doc_id, i, tag,
         CASE WHEN tag LIKE 'B-%' OR (tag LIKE 'I-%' AND (prev IS NULL OR prev = 'O'
              OR substr(prev, 3) <> substr(tag, 3))) THEN 1 ELSE 0 END AS is_start
  FROM (SELECT *, lag(tag) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM mtag))""", """ch AS (
  SELECT *, sum(is_start) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS cid FROM st)""") + """
SELECT doc_id, substr(arg_min(tag, i), 3) AS type, CAST(min(i) AS BIGINT) AS s, CAST(max(i) + 1 AS BIGINT) AS e
FROM ch WHERE tag <> 'O' GROUP BY doc_id, cid""")
def bio_to_spans(spark, sf):
    t = _with_tags(spark, sf)
    return (explode_rows(t, tg.bio_to_spans_expr("mix_tags"), ["doc_id"])
             .select("doc_id", "type", F.col("s").cast("bigint"), F.col("e").cast("bigint")))


@register("token_accuracy", O.with_(_C, _CHARS, _GTAG, _PTAG) + f"""
SELECT round({O.ratio('n_equal', 'n_tags')}, 6) AS accuracy, n_tags, n_equal FROM (
  SELECT CAST(count(*) AS BIGINT) AS n_tags, CAST(count(*) FILTER (WHERE g.tag = p.tag) AS BIGINT) AS n_equal
  FROM gtag g JOIN ptag p ON g.doc_id = p.doc_id AND g.i = p.i)""")
def token_accuracy(spark, sf):
    return tg.token_accuracy(_with_tags(spark, sf), "gold_tags", "pred_tags")


@register("bio_transition_audit", O.with_(_C, _CHARS, _GTAG, _PTAG, _MTAG) + """
SELECT prev_tag, tag, CAST(count(*) AS BIGINT) AS n,
       (tag LIKE 'B-%' OR tag = 'O' OR ((prev_tag LIKE 'B-%' OR prev_tag LIKE 'I-%') AND tag LIKE 'I-%'
        AND substr(prev_tag, 3) = substr(tag, 3))) AS legal
FROM (SELECT tag, coalesce(lag(tag) OVER (PARTITION BY doc_id ORDER BY i), '<s>') AS prev_tag FROM mtag)
GROUP BY prev_tag, tag""")
def bio_transition_audit(spark, sf):
    return tg.transition_audit(_with_tags(spark, sf), "mix_tags")


@register("label_vocab", O.with_(_C) + """
SELECT CAST(0 AS BIGINT) AS label_id, 'O' AS label, CAST(NULL AS VARCHAR) AS type
UNION ALL SELECT CAST(2 * k + 1 AS BIGINT), 'B-' || type, type FROM (SELECT type, row_number() OVER (ORDER BY type) - 1 AS k FROM (SELECT DISTINCT type FROM gold))
UNION ALL SELECT CAST(2 * k + 2 AS BIGINT), 'I-' || type, type FROM (SELECT type, row_number() OVER (ORDER BY type) - 1 AS k FROM (SELECT DISTINCT type FROM gold))""")
def label_vocab(spark, sf):
    v = tg.label_vocab(fx.gold_rows(spark, sf))
    return v.select(F.col("label_id").cast("bigint"), "label", "type")


@register("known_types", O.with_(_C) + f"""
SELECT doc_id, type, s, e FROM pred WHERE type IN {KNOWN!r}""".replace('"', "'"))
def known_types(spark, sf):
    vocab = tg.label_vocab(spark.createDataFrame([(t,) for t in KNOWN], "type string"))
    return tg.known_types(fx.pred_rows(spark, sf), vocab).select("doc_id", "type", "s", "e")


@register("explode_chars", O.with_(_C, _CHARS, _GTAG) + """
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(*) FILTER (WHERE tag <> 'O') AS BIGINT) AS n_tagged
FROM gtag GROUP BY doc_id""")
def explode_chars(spark, sf):
    t = tg.explode_chars(_with_tags(spark, sf).select("doc_id", "text", F.col("gold_tags").alias("tags")))
    return keep_if(t, (F.size("tokens") > 0) & (F.length("text") > 0)).select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
        F.size(F.filter("ner_tags", lambda x: x != "O")).cast("bigint").alias("n_tagged"))
