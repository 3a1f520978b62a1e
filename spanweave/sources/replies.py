"""Reply tables derived from the annotated documents.

Every document with a gold entity gets one model reply; its shape is picked
by ``doc_id % 8`` so that every parser branch is exercised on real text:

0 bare array, 1 code fence, 2 a stray ``[1]`` before the array, 3 after the
answer marker, 4 cut by 3 characters, 5 ``[]``, 6 extra invalid elements
(unknown type, out-of-range span, short span, bare string, brackets in a name,
an array twenty levels deep), 7 an annotation
tag pair around ``{"text", "entities"}`` whose offsets are partly wrong.

Replies are built inside each row from the gold array: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.sources import fixtures as fx
from spanweave.sources.tables import keep_if

# Fixed reply pieces (shared with the SQL oracle).
FENCE_OPEN = "```json\n"
FENCE_CLOSE = "\n```"
CITATION = "See [1].\n"
ANSWER_PREFIX = "回答: "
EXTRA_ELEMENTS = ('{"type":"unknown","text":"x","span":[0,1]},'
                  '{"type":"person","text":"x","span":[0,%d]},'
                  '{"type":"person","text":"x","span":[3]},"bare",'
                  '{"type":"work","text":"] [ \\"]","span":[0,2]},' + "[" * 20 + "]" * 20)
MISSING_ENTITY = '{"type":"work","name":"ZZZZ","start":0,"end":4}'
EMPTY_ENTITY = '{"type":"person","name":"","start":0,"end":0}'


def _json_escape(c):
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, variant, reply`` for documents with a gold entity
    (materialised once per application: replies are stored, not recomputed)."""
    return fx.materialized(spark, ("responses", sf_dir), lambda: _build(spark, sf_dir))


def _build(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.annotated(spark, sf_dir).select("doc_id", "text", "gold")
    usable = F.filter("gold", lambda x: ~x["name"].contains('"') & ~x["name"].contains("\\"))
    a = keep_if(a.withColumn("g", usable), F.size("gold") > 0)
    items = F.transform("g", lambda x: F.concat(
        F.lit('{"type":"'), x["type"], F.lit('","text":"'), x["name"], F.lit('","span":['),
        x["s"].cast("string"), F.lit(","), x["e"].cast("string"), F.lit("]}")))
    body = F.array_join(items, ",")
    arr = F.concat(F.lit("["), body, F.lit("]"))
    shift = F.expr("transform(g, x -> named_struct('x', x, 'd', "
                   "CASE WHEN substr(md5(concat('fix:', CAST(doc_id AS STRING), ':', CAST(x.s AS STRING))), 1, 1) = '3' "
                   "THEN 1 ELSE 0 END))")
    syn = F.transform(shift, lambda y: F.concat(
        F.lit('{"type":"'), y["x"]["type"], F.lit('","name":"'), y["x"]["name"], F.lit('","start":'),
        (y["x"]["s"] + y["d"]).cast("string"), F.lit(',"end":'), (y["x"]["e"] + y["d"]).cast("string"),
        F.lit("}")))
    syn_body = F.concat_ws(",", F.array_join(syn, ","), F.lit(MISSING_ENTITY), F.lit(EMPTY_ENTITY))
    n = F.length("text")
    v = (F.col("doc_id") % 8).cast("int")
    reply = (F.when(v == 0, arr)
              .when(v == 1, F.concat(F.lit(FENCE_OPEN), arr, F.lit(FENCE_CLOSE)))
              .when(v == 2, F.concat(F.lit(CITATION), arr))
              .when(v == 3, F.concat(F.lit(ANSWER_PREFIX), arr))
              .when(v == 4, F.call_function("substring", arr, F.lit(1), F.length(arr) - 3))
              .when(v == 5, F.lit("[]"))
              .when(v == 6, F.concat(F.lit("["), body, F.lit(","),
                                     F.format_string(EXTRA_ELEMENTS, n + 5),
                                     F.lit("]")))
              .otherwise(F.concat(F.lit("<start_annotation>\n{\"text\":\""), _json_escape(F.col("text")),
                                  F.lit('","entities":['), syn_body, F.lit("]}\n</end_annotation>"))))
    return a.select("doc_id", "text", v.alias("variant"), reply.alias("reply"))
