"""Streaming queries: the jobs run to completion with availableNow over files
written from the derived tables; the query returns the final state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanweave import oracle as O
from spanweave.catalog import register
from spanweave.operators import entities as ent
from spanweave.queries.parsing_q import _BASE as _REPLY_BASE, _EXTRACT
from spanweave.session import scratch_path
from spanweave.sources import fixtures as fx
from spanweave.sources import replies as RP
from spanweave.sources import runs as RS
from spanweave.streaming import jobs as J


def _dirs(spark, tag):
    base = scratch_path(spark, f"stream-{tag}-{uuid.uuid4().hex}")
    return f"{base}/in", f"{base}/out", f"{base}/ckpt"


@register("stream_distribution", O.with_(O.cand_ctes(), O.split_cte(), """t AS (
  SELECT type, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS p FROM gold GROUP BY type)""", """r AS (
  SELECT type, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS p FROM gold JOIN splits USING (doc_id)
  WHERE split IN ('train', 'validation') GROUP BY type)""") + """
SELECT type, CAST(n AS BIGINT) AS n, round(t.p, 4) AS percentage, round(round(t.p, 4) - coalesce(r.p, 0), 4) AS gap
FROM t LEFT JOIN r USING (type)""")
def stream_distribution(spark, sf):
    src, out, ck = _dirs(spark, "dist")
    s = fx.samples(spark, sf, with_split=False).select("text", "entities")
    s.repartition(4).write.json(src)          # several files, like a folder of generated batches
    known = fx.samples(spark, sf).where(F.col("split").isin("train", "validation"))
    real = ent.entity_distribution(ent.explode_entities(known), digits=None)
    real = real.select("type", F.round(100.0 * F.col("ratio"), 4).alias("percentage"))
    J.stream_distribution(spark, src, out, ck, real=real)
    return J.latest(spark, out).select("type", F.col("n").cast("bigint").alias("n"), "percentage", "gap")


@register("stream_responses", _REPLY_BASE + _EXTRACT + """
SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM rep WHERE outcome IN ('kept', 'moved') GROUP BY outcome""")
def stream_responses(spark, sf):
    src, out, ck = _dirs(spark, "resp")
    r = RP.responses(spark, sf).select(F.col("doc_id").alias("task_id"), F.col("reply").alias("body"),
                                       F.lit("2025-01-01 00:00:00").cast("timestamp").alias("received"))
    r.unionByName(r.where(F.col("task_id") % 5 == 0)).write.json(src)   # repeated deliveries
    J.stream_responses(spark, src, out, ck)
    return spark.read.parquet(out).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_LOG = """WITH log AS (
  SELECT CASE WHEN substr(h, 1, 1) = '0' THEN 'failed' ELSE 'success' END AS status, day, day // 2 + CASE WHEN substr(h, 4, 1) IN ('e', 'f') THEN 2 ELSE 0 END AS wave,
         TIMESTAMP '2025-01-01 00:00:00' + to_seconds(day * 86400 + (n * 37) % 86400) AS ts
  FROM (SELECT h, n, CAST('0x' || substr(h, 2, 2) AS INTEGER) % 8 AS day
        FROM (SELECT coalesce(length(text), 0) AS n, md5('run:' || CAST(doc_id AS VARCHAR)) AS h FROM documents))),
mark AS (SELECT w.wave, (SELECT max(ts) FROM log b WHERE b.wave < w.wave) - INTERVAL 1 DAY AS late FROM (SELECT DISTINCT wave FROM log) w),
judged AS (
  SELECT l.*, DATE '2025-01-01' + l.day AS d, coalesce(TIMESTAMP '2025-01-01 00:00:00' + to_days(l.day + 1) <= m.late, false) AS dropped
  FROM log l JOIN mark m USING (wave))"""


@register("stream_runs", _LOG + """
SELECT d AS day, status, count(*) FILTER (WHERE NOT dropped)::BIGINT AS runs, count(*) FILTER (WHERE dropped)::BIGINT AS late,
       CAST(d AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM log) - INTERVAL 1 DAY AS closed
FROM judged GROUP BY d, status""")
def stream_runs(spark, sf):
    src, out, ck = _dirs(spark, "runs")
    log = RS.run_log(spark, sf)
    # the log arrives wave after wave, late runs two waves after their day
    for wave in range(RS.LOG_DAYS // RS.LOG_WAVE + 2):
        log.where(F.col("wave") == wave).drop("wave").write.mode("append").json(src)
        J.stream_runs(spark, src, out, ck)
    counted = J.runs_per_window(spark, out, ck)
    return J.late_runs(spark, src, counted).select(F.to_date("start").alias("day"), "status", "runs", "late", "closed")
