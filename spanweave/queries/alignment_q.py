"""Token alignment queries: W5, J8, B1, B9, P9, P10."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave import oracle as O
from spanweave.catalog import register
from spanweave.operators import alignment as AL
from spanweave.operators import tagging as TG
from spanweave.sources import fixtures as fx
from spanweave.sources.tables import explode_rows

TYPES = ("damage", "datetime", "location", "person", "work")
TYPE_IDS = {t: k for k, t in enumerate(TYPES)}
KNOWN_LABELS = ("O", "B-damage", "I-damage", "B-datetime", "I-datetime", "B-location", "I-location",
                "B-person", "I-person")           # vocabulary without 'work': ids 9, 10 are unknown
MAXLEN = 512
_C = O.cand_ctes()
_TYPE_K = "CASE {t} WHEN 'damage' THEN 0 WHEN 'datetime' THEN 1 WHEN 'location' THEN 2 WHEN 'person' THEN 3 ELSE 4 END"


def _al_cte(name, src):
    """Tokens that hold a span's first and last character: the last token that
    begins at or before it, if it reaches that far."""
    return f"""{name} AS (
  SELECT x.doc_id, x.type, x.s, x.e, x.p1 AS first_tok, c.pos AS last_tok FROM (
    SELECT y.doc_id, y.type, y.s, y.e, y.e - 1 AS last_char, c.pos AS p1 FROM {src} y ASOF JOIN tok c ON c.doc_id = y.doc_id AND y.s >= c.off
    WHERE y.s < c.off + length(c.tok)) x ASOF JOIN tok c ON c.doc_id = x.doc_id AND x.last_char >= c.off
  WHERE x.last_char < c.off + length(c.tok))"""


def _lab_cte(name, al):
    k = _TYPE_K.format(t="type")
    return f"""{name} AS (
  SELECT t.doc_id, t.pos, CAST(floor(t.pos / {MAXLEN - 2}) AS INTEGER) AS w, coalesce(arg_max(x.lid, x.s), 0) AS lid
  FROM tok t LEFT JOIN (
    SELECT doc_id, s, p, CASE WHEN p = first_tok THEN 2 * {k} + 1 ELSE 2 * {k} + 2 END AS lid
    FROM (SELECT *, unnest(range(first_tok, last_tok + 1)) AS p FROM {al})) x
    ON x.doc_id = t.doc_id AND x.p = t.pos
  GROUP BY t.doc_id, t.pos)"""


_ALIGN = O.with_(_C, _al_cte("ga", "gold"), _al_cte("pa", "pred"), _lab_cte("gl", "ga"), _lab_cte("pl", "pa"))


def _rows(spark, sf):
    a = fx.annotated(spark, sf)
    g = AL.token_label_rows(a, "gold", TYPE_IDS).select("doc_id", "window_idx", F.col("labels").alias("gold_labels"))
    p = AL.token_label_rows(a, "pred", TYPE_IDS).select("doc_id", "window_idx", F.col("labels").alias("pred_labels"))
    p = g.join(p, ["doc_id", "window_idx"])
    n = 2 * len(TYPES) + 1
    scores = F.expr(f"zip_with(gold_labels, pred_labels, (g, p) -> transform(sequence(0, {n - 1}), "
                    "j -> CAST((CASE WHEN j = p THEN 2 ELSE 0 END) + (CASE WHEN j = g THEN 1 ELSE 0 END) AS DOUBLE)))")
    return p.withColumn("scores", scores).withColumn("preds", AL.argmax_labels(F.col("scores")))


@register("token_offsets", O.with_(_C) + "SELECT doc_id, pos, tok, off AS start, CAST(off + length(tok) AS BIGINT) AS \"end\" FROM tok")
def token_offsets(spark, sf):
    return AL.token_offsets(fx.docs(spark, sf))


@register("span_to_tokens", O.with_(_C, _al_cte("ga", "gold")) +
          "SELECT doc_id, type, s, e, CAST(first_tok AS BIGINT) AS first_tok, CAST(last_tok AS BIGINT) AS last_tok FROM ga")
def span_to_tokens(spark, sf):
    a = fx.annotated(spark, sf)
    x = explode_rows(a, AL.span_to_tokens(a, "gold"), ["doc_id"])
    return x.select("doc_id", "type", F.col("s").cast("bigint"), F.col("e").cast("bigint"),
                    F.col("first_tok").cast("bigint"), F.col("last_tok").cast("bigint"))


@register("token_label_rows", O.with_(_C, _al_cte("ga", "gold"), _lab_cte("gl", "ga")) + """
SELECT doc_id, w AS window_idx, CAST(count(*) + 2 AS BIGINT) AS n_positions,
       md5('-100,' || string_agg(lid::VARCHAR, ',' ORDER BY pos) || ',-100') AS labels_md5 FROM gl GROUP BY doc_id, w""")
def token_label_rows(spark, sf):
    r = AL.token_label_rows(fx.annotated(spark, sf), "gold", TYPE_IDS)
    return r.select("doc_id", "window_idx", F.size("labels").cast("bigint").alias("n_positions"),
                    F.md5(F.array_join(F.transform("labels", lambda x: x.cast("string")), ",")).alias("labels_md5"))


_BOTH = _ALIGN + " "


@register("argmax_labels", _BOTH + """
SELECT doc_id, w AS window_idx, CAST(count(*) + 2 AS BIGINT) AS n_positions, CAST(count(*) FILTER (WHERE lid > 0) AS BIGINT) AS n_pred_entity
FROM pl GROUP BY doc_id, w""")
def argmax_labels(spark, sf):
    r = _rows(spark, sf)
    return r.select("doc_id", "window_idx", F.size("preds").cast("bigint").alias("n_positions"),
                    F.size(F.filter("preds", lambda x: x > 0)).cast("bigint").alias("n_pred_entity"))


@register("mask_ignored", _BOTH + """
SELECT g.doc_id, g.w AS window_idx, CAST(count(*) AS BIGINT) AS n_positions, CAST(count(*) FILTER (WHERE g.lid = p.lid) AS BIGINT) AS n_equal
FROM gl g JOIN pl p ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY g.doc_id, g.w""")
def mask_ignored(spark, sf):
    r = TG.mask_ignored(_rows(spark, sf).select("doc_id", "window_idx", F.col("gold_labels").alias("labels"), "preds"))
    eq = F.size(F.filter(F.arrays_zip("labels", "preds"), lambda z: z["labels"] == z["preds"]))
    return r.select("doc_id", "window_idx", F.size("labels").cast("bigint").alias("n_positions"), eq.cast("bigint").alias("n_equal"))


_UNK = " ".join(f"WHEN {i} THEN '{lab}'" for i, lab in enumerate(KNOWN_LABELS))


@register("ids_to_labels", _BOTH + f"""
SELECT CASE lid {_UNK} ELSE 'UNK-' || lid END AS label, CAST(count(*) AS BIGINT) AS n FROM pl GROUP BY 1""")
def ids_to_labels(spark, sf):
    vocab = spark.createDataFrame([(i, lab) for i, lab in enumerate(KNOWN_LABELS)], "label_id int, label string")
    r = TG.mask_ignored(_rows(spark, sf).select("doc_id", F.col("gold_labels").alias("labels"), "preds"))
    lab = TG.ids_to_labels(r, vocab, "preds", "names").select(F.explode("names").alias("label"))
    return lab.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
