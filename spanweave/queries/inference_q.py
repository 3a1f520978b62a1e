"""Prompt and inference queries: F7, F8, B2, B7, B8, J3, J4, U4, A15, A16, B10.

Model calls use the deterministic stub client, so these are row checks
(F8 has an exact SQL oracle: the prompt text is plain concatenation).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanweave import oracle as O
from spanweave.catalog import register
from spanweave.functions import prompts as PR
from spanweave.operators import entities as ent
from spanweave.operators import batching as BT
from spanweave.operators import inference as INF
from spanweave.operators import parsing as P
from spanweave.operators import planning as PL
from spanweave.plans.evaluate import evaluate_llm
from spanweave.queries import planning_q as PQ
from spanweave.session import scratch_path
from spanweave.sources import fixtures as fx
from spanweave.sources.tables import explode_rows

TYPES = ["damage", "datetime", "location", "person", "work"]
_PREFIX = ("Extract named entities of these types:\n" + PR.type_block(TYPES) + "\n" + PR.ANSWER_FORMAT + "\n"
           + "\nText: ")


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _prompts(spark, sf):
    d = fx.docs(spark, sf)
    return d.select(F.col("doc_id").alias("task_id"), "text", PR.extraction_prompt(F.col("text"), TYPES).alias("prompt"))


@register("extraction_prompt", O.with_(O.docs_cte()) + f"""
SELECT doc_id AS task_id, md5({_sql_lit(_PREFIX)} || text || {_sql_lit(chr(10) + 'Answer:')}) AS prompt_md5,
       CAST(length({_sql_lit(_PREFIX)} || text || {_sql_lit(chr(10) + 'Answer:')}) AS BIGINT) AS n_chars FROM docs""")
def extraction_prompt(spark, sf):
    p = _prompts(spark, sf)
    return p.select("task_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("n_chars"))


_SHOTS = """shot AS (
  SELECT d.doc_id, d.text, '[' || string_agg('{"type": "' || g.type || '", "text": "' || replace(replace(g.name, '\\', '\\\\'), '"', '\\"')
         || '", "span": [' || CAST(g.s AS VARCHAR) || ', ' || CAST(g.e AS VARCHAR) || ']}', ', ' ORDER BY g.s) || ']' AS ents
  FROM docs d JOIN gold g USING (doc_id) WHERE d.doc_id IN (SELECT doc_id FROM docs JOIN gold USING (doc_id) GROUP BY doc_id ORDER BY count(*) DESC, doc_id LIMIT 3)
  GROUP BY d.doc_id, d.text),
block AS (
  SELECT string_agg('Example ' || CAST(i AS VARCHAR) || ':' || chr(10) || 'Text: ' || text || chr(10) || ents, chr(10) || chr(10) ORDER BY i) AS b
  FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM shot))"""
_HEAD = _PREFIX[:-len("\nText: ")]


@register("extraction_prompt_3shot", O.with_(O.cand_ctes(), _SHOTS) + f"""
SELECT doc_id AS task_id, md5({_sql_lit(_HEAD)} || chr(10) || b || chr(10) || chr(10) || 'Text: ' || text || {_sql_lit(chr(10) + 'Answer:')}) AS prompt_md5
FROM docs, block""")
def extraction_prompt_3shot(spark, sf):
    a = fx.annotated(spark, sf).where(F.size("gold") > 0)
    best = a.orderBy(F.desc(F.size("gold")), "doc_id").limit(3).select("doc_id", "text", "gold").collect()   # the k examples
    examples = [(r.text, [{"type": g.type, "text": g.name, "span": [g.s, g.e]} for g in r.gold]) for r in sorted(best, key=lambda r: r.doc_id)]
    p = PR.extraction_prompt(F.col("text"), TYPES, examples)
    return fx.docs(spark, sf).select(F.col("doc_id").alias("task_id"), F.md5(p).alias("prompt_md5"))


_GLOSS = "CASE type " + " ".join(f"WHEN '{t}' THEN {_sql_lit(g)}" for t, g in PR.GLOSSES.items()) + " ELSE type END"
_SYNTH = """tops AS (SELECT type, string_agg(name, ', ' ORDER BY rank) AS names FROM rn WHERE rank <= 5 GROUP BY type),
kinds AS (SELECT unnest(['damage', 'datetime', 'location', 'person', 'work']) AS type),
tblock AS (
  SELECT string_agg('- ' || type || ': ' || """ + _GLOSS + """ || coalesce(' (e.g. ' || names || ')', ''), chr(10) ORDER BY type) AS tb
  FROM kinds LEFT JOIN tops USING (type)),
rich AS (
  SELECT d.doc_id, d.text, count(*) AS n, '[' || string_agg('{"type": "' || g.type || '", "name": "' || replace(replace(g.name, '\\', '\\\\'), '"', '\\"')
         || '", "span": [' || CAST(g.s AS VARCHAR) || ', ' || CAST(g.e AS VARCHAR) || ']}', ', ' ORDER BY g.s) || ']' AS ents
  FROM docs d JOIN gold g USING (doc_id) WHERE NOT regexp_matches(d.text, '[?☆〈〉]') GROUP BY d.doc_id, d.text
  HAVING count(*) >= 10 AND count(*) FILTER (WHERE regexp_matches(g.name, '[?☆〈〉]')) = 0 ORDER BY n DESC, doc_id LIMIT 3),
eblock AS (
  SELECT string_agg('Example ' || CAST(i AS VARCHAR) || ':' || chr(10) || 'Text: ' || text || chr(10) || ents, chr(10) || chr(10) ORDER BY i) AS eb
  FROM (SELECT *, row_number() OVER (ORDER BY n DESC, doc_id) AS i FROM rich)),
tk AS (SELECT CAST(row_number() OVER (ORDER BY ratio DESC, type, rank, rep) - 1 AS BIGINT) AS task_id, type, name FROM pt)"""


@register("synthesis_prompt", O.with_(PQ._G, PQ._DIST, PQ._PLAN, PQ._RANKED, PQ._PT, _SYNTH) + f"""
SELECT task_id, md5('Generate a realistic annotated text.' || chr(10) || 'Entity types:' || chr(10) || tb || chr(10) || chr(10) || eb || chr(10) || chr(10)
       || 'Task: write a text that mentions ' || name || ' (' || type || ')' || '.' || chr(10) || {_sql_lit(PR.SYNTH_FORMAT)}) AS prompt_md5
FROM tk, tblock, eblock""")
def synthesis_prompt(spark, sf):
    ents = ent.explode_entities(fx.samples(spark, sf, garbled=True, with_split=False))
    top = ent.top_entities_per_type(ents, 5).orderBy("type", "rank").collect()      # <= 5 per type
    names: dict[str, list[str]] = {}
    for r in top:
        names.setdefault(r["type"], []).append(r["name"])
    rich = ent.few_shot_richest(fx.samples(spark, sf, garbled=True, with_split=False), 3).collect()
    examples = [(r["text"], [e.asDict(recursive=True) for e in r["entities"]]) for r in rich]
    plan = PL.generation_plan(ent.entity_distribution(ents, digits=None))
    tasks = PL.tasks_balanced(plan, ent.top_entities_per_type(ents, PL.max_top_n(plan)))
    p = tasks.select("task_id", PR.synthesis_prompt(F.col("targets"), TYPES, names, examples).alias("prompt"))
    return p.select("task_id", F.md5("prompt").alias("prompt_md5"))


_ANS = """ans AS (
  SELECT d.doc_id, d.text,
         coalesce('[' || string_agg('{"type":"' || g.type || '","text":"' || replace(replace(g.name, '\\', '\\\\'), '"', '\\"')
                  || '","span":[' || CAST(g.s AS VARCHAR) || ',' || CAST(g.e AS VARCHAR) || ']}', ',' ORDER BY g.s) || ']', '[]') AS answer
  FROM docs d LEFT JOIN gold g USING (doc_id) GROUP BY d.doc_id, d.text)"""


@register("sft_rows", O.with_(O.cand_ctes(), _ANS) + f"""
SELECT doc_id, CAST(w AS INTEGER) AS window_idx, md5(substr(f, CAST(w * 4096 + 1 AS BIGINT), 4096)) AS input_md5,
       CAST(least(greatest(n - w * 4096, 0), least(length(f) - w * 4096, 4096)) AS INTEGER) AS n_ignore
FROM (SELECT doc_id, f, n, unnest(range(0, CAST(ceil(length(f) / 4096.0) AS BIGINT))) AS w
      FROM (SELECT doc_id, p || answer AS f, length(p) AS n
            FROM (SELECT doc_id, answer, {_sql_lit(_PREFIX)} || text || {_sql_lit(chr(10) + 'Answer:')} AS p FROM ans)))""")
def sft_rows(spark, sf):
    a = fx.annotated(spark, sf)
    ans = F.to_json(F.transform("gold", lambda x: F.struct(x["type"].alias("type"), x["name"].alias("text"),
                                                        F.array(x["s"], x["e"]).alias("span"))))
    r = explode_rows(a, PR.sft_windows(PR.extraction_prompt(F.col("text"), TYPES), ans), ["doc_id"])
    return r.select("doc_id", "window_idx", F.md5("input").alias("input_md5"), "n_ignore")


# The stub client's behaviour in SQL: the first call fails when md5(prompt)
# starts with '0'; the answer lists the capitalised words (the gold rule) as
# Python's json.dumps writes them.
_STUB = O.with_(O.cand_ctes(), f"""pr AS (
  SELECT doc_id AS task_id, {_sql_lit(_PREFIX)} || text || {_sql_lit(chr(10) + 'Answer:')} AS p FROM docs)""", """bd AS (
  SELECT pr.task_id, pr.p, substr(md5(pr.p), 1, 1) = '0' AS first_fails,
         coalesce('[' || string_agg('{"type": "' || g.type || '", "text": "' || replace(replace(g.name, '\\', '\\\\'), '"', '\\"')
                  || '", "span": [' || CAST(g.s AS VARCHAR) || ', ' || CAST(g.e AS VARCHAR) || ']}', ', ' ORDER BY g.s) || ']', '[]') AS body
  FROM pr LEFT JOIN gold g ON g.doc_id = pr.task_id GROUP BY pr.task_id, pr.p)""")


def _stub():
    return INF.StubExtractionClient()


@register("run_inference", _STUB + """
SELECT task_id, CAST(CASE WHEN first_fails THEN 1 ELSE 0 END AS INTEGER) AS attempt, true AS ok,
       CAST(length(body) AS INTEGER) AS body_len FROM bd""")
def run_inference(spark, sf):
    r = INF.run_inference(_prompts(spark, sf), _stub, max_retries=3)
    return r.select("task_id", "attempt", "ok", F.length("body").alias("body_len"))


def _batch_client(folder):
    return lambda attempt: BT.FolderBatchClient(folder, attempt)


@register("run_inference_batch", _STUB + """
SELECT task_id, CAST(CASE WHEN first_fails THEN 1 ELSE 0 END AS INTEGER) AS attempt, true AS ok, md5(body) AS body_md5,
       CAST(length(p) // 4 AS BIGINT) AS input_tokens, CAST(length(body) // 4 AS BIGINT) AS output_tokens FROM bd""")
def run_inference_batch(spark, sf):
    path = scratch_path(spark, f"batches-{uuid.uuid4().hex}")
    r = BT.run_batch_inference(_prompts(spark, sf), _batch_client(f"{path}/provider"), path, chunk_size=100)
    return r.select("task_id", "attempt", "ok", F.md5("body").alias("body_md5"), "input_tokens", "output_tokens")


def _rounds(spark, sf):
    path = scratch_path(spark, f"rounds-{uuid.uuid4().hex}")
    return INF.retry_rounds(_prompts(spark, sf), _stub, path, rounds=2, max_retries=1)


@register("retry_rounds", _STUB + """
SELECT task_id, CAST(CASE WHEN first_fails THEN 1 ELSE 0 END AS INTEGER) AS attempt, true AS ok FROM bd""")
def retry_rounds(spark, sf):
    return _rounds(spark, sf).select("task_id", "attempt", "ok")


@register("accumulate_rounds", _STUB + """
SELECT CAST(CASE WHEN first_fails THEN 1 ELSE 0 END AS INTEGER) AS attempt, true AS ok, CAST(count(*) AS BIGINT) AS n
FROM bd GROUP BY 1""")
def accumulate_rounds(spark, sf):
    r = _rounds(spark, sf)
    return r.groupBy("attempt", "ok").agg(F.count(F.lit(1)).alias("n"))


@register("failed_tasks", _STUB + "SELECT task_id FROM bd WHERE first_fails")
def failed_tasks(spark, sf):
    t = _prompts(spark, sf)
    first = INF.run_inference(t, _stub, max_retries=1)
    return INF.failed_tasks(t, first).select("task_id")


@register("attach_responses", _STUB + """
SELECT task_id, NOT first_fails AS ok, CASE WHEN first_fails THEN NULL ELSE CAST(length(body) AS INTEGER) END AS body_len FROM bd""")
def attach_responses(spark, sf):
    t = _prompts(spark, sf)
    r = INF.run_inference(t, _stub, max_retries=1)
    return INF.attach_responses(t.select("task_id"), r).select("task_id", "ok", F.length("body").alias("body_len"))


@register("usage_totals", _STUB + """
SELECT 'stub' AS model, CAST(count(*) AS BIGINT) AS calls, CAST(sum(length(p) // 4) AS BIGINT) AS input_tokens,
       CAST(sum(length(body) // 4) AS BIGINT) AS output_tokens,
       CAST(sum(length(p) // 4) + sum(length(body) // 4) AS BIGINT) AS total_tokens FROM bd""")
def usage_totals(spark, sf):
    r = INF.run_inference(_prompts(spark, sf), _stub, max_retries=3).withColumn("model", F.lit("stub"))
    return INF.usage_totals(r)


@register("generation_summary", _STUB + """
SELECT CAST(count(*) AS BIGINT) AS target, CAST(count(*) FILTER (WHERE NOT first_fails AND body <> '[]') AS BIGINT) AS generated,
       CAST(count(*) - count(*) FILTER (WHERE NOT first_fails AND body <> '[]') AS BIGINT) AS failed,
       round(count(*) FILTER (WHERE NOT first_fails AND body <> '[]') / count(*), 6) AS completion_rate FROM bd""")
def generation_summary(spark, sf):
    t = _prompts(spark, sf)
    r = INF.run_inference(t, _stub, max_retries=1)
    parsed = P.parse_entities(r.join(t.select("task_id", "text"), "task_id").where("ok"), "body", "text", TYPES)
    return INF.generation_summary(t, parsed.where(F.size("entities") > 0))


_NOISY = f"""no AS (
  SELECT doc_id, s, e, name, type, CASE WHEN substr(md5(name), 1, 1) IN ('2', '3') THEN 'person' ELSE type END AS said,
         substr(md5(name), 1, 1) NOT IN ('0', '1') AS kept
  FROM gold JOIN splits USING (doc_id) WHERE split = 'test'),
sc AS (
  SELECT count(*) FILTER (WHERE kept) AS n_pred, count(*) FILTER (WHERE kept AND said = type) AS tp, count(*) AS support,
         coalesce(sum(e - s) FILTER (WHERE NOT kept OR said <> type), 0) AS wrong FROM no),
us AS (
  SELECT count(*) AS samples, sum(length(p) // 4) AS input_tokens, sum(length(b) // 4) AS output_tokens, sum(length(text)) AS chars FROM (
    SELECT pr.task_id, pr.p, d.text,
           coalesce('[' || string_agg('{{"type": "' || g.said || '", "text": "' || replace(replace(g.name, '\\', '\\\\'), '"', '\\"')
             || '", "span": [' || CAST(g.s AS VARCHAR) || ', ' || CAST(g.e AS VARCHAR) || ']}}', ', ' ORDER BY g.s) FILTER (WHERE g.kept) || ']', '[]') AS b
    FROM pr JOIN splits s ON s.doc_id = pr.task_id JOIN docs d ON d.doc_id = pr.task_id LEFT JOIN no g ON g.doc_id = pr.task_id
    WHERE s.split = 'test' GROUP BY pr.task_id, pr.p, d.text))"""


@register("evaluate_llm", _STUB + "," + O.split_cte() + "," + _NOISY + f"""
SELECT 'stub' AS model, round({O.ratio('tp', 'n_pred')}, 6) AS precision, round({O.ratio('tp', 'support')}, 6) AS recall,
       round({O.ratio('2 * tp', 'n_pred + support')}, 6) AS f1, round(1.0 - wrong / chars, 6) AS accuracy,
       CAST(samples AS BIGINT) AS samples, CAST(samples AS BIGINT) AS calls,
       CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens FROM sc, us""")
def evaluate_llm_q(spark, sf):
    s = fx.samples(spark, sf).where(F.col("split") == "test").select("sample_id", "text")
    g = fx.annotated(spark, sf).select(F.col("doc_id").alias("sample_id"), "gold")
    return evaluate_llm(s.join(g, "sample_id"), TYPES, lambda: INF.StubExtractionClient(noisy=True))
