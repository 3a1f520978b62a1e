"""Corpus text queries: F6 chunk_text, A19 chunk_summary, S4 read_corpus_lines, B3 mlm_rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanweave.catalog import register
from spanweave.operators import corpus as C
from spanweave.session import scratch_path
from spanweave.sources.corpus import doc_lines, read_corpus_lines

MAX_LEN = 128
_ENDS = "('。', '．', '.', '！', '!', '？', '?', '」', '』', chr(10))"

_SEG_SQL = f"""WITH lines AS (
  SELECT doc_id * 1000000000 + pos AS line_id, line, length(line) AS n FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)),
pts AS (
  SELECT line_id, line, n, list_transform(list_filter(range(1, n + 1), lambda i: ch[i] IN {_ENDS}) || [n],
           lambda p: {{'s': p, 'l': p, 'c': []::BIGINT[]}}) AS p
  FROM (SELECT line_id, line, n, string_split(line, '') AS ch FROM lines WHERE n > {MAX_LEN})),
cut AS (
  SELECT line_id, line, list_reduce(p, lambda acc, x: CASE WHEN x.s - acc.s <= {MAX_LEN} THEN {{'s': acc.s, 'l': x.s, 'c': acc.c}} ELSE
      {{'s': greatest(acc.s, acc.l) + greatest(0, CAST(ceil((x.s - greatest(acc.s, acc.l)) / {MAX_LEN}.0) AS BIGINT) - 1) * {MAX_LEN}, 'l': x.s,
        'c': acc.c || CASE WHEN acc.l > acc.s THEN [acc.l] ELSE []::BIGINT[] END
             || [greatest(acc.s, acc.l) + j * {MAX_LEN} for j in range(1, greatest(0, CAST(ceil((x.s - greatest(acc.s, acc.l)) / {MAX_LEN}.0) AS BIGINT) - 1) + 1)]}} END,
      {{'s': 0::BIGINT, 'l': 0::BIGINT, 'c': []::BIGINT[]}}).c || [n] AS ends FROM pts),
pieces AS (
  SELECT line_id, i, regexp_replace(substr(line, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)), '^\\s+|\\s+$', '', 'g') AS segment
  FROM (SELECT line_id, line, unnest([0::BIGINT] || ends[:-2]) AS a, unnest(ends) AS b, generate_subscripts(ends, 1) AS i FROM cut)),
segs AS (
  SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY i) - 1 AS seg_idx, segment FROM pieces WHERE segment <> ''
  UNION ALL SELECT line_id, 0, line FROM lines WHERE n <= {MAX_LEN})
"""


@register("chunk_text", _SEG_SQL + "SELECT line_id, CAST(seg_idx AS BIGINT) AS seg_idx, segment FROM segs")
def chunk_text(spark, sf):
    s = C.chunk_text(doc_lines(spark, sf), MAX_LEN)
    return s.select("line_id", F.col("seg_idx").cast("bigint"), "segment")


@register("chunk_summary", _SEG_SQL + """
SELECT count(*)::BIGINT AS lines_in, sum(k)::BIGINT AS segments_out, sum(CASE WHEN n > 128 THEN k - 1 ELSE 0 END)::BIGINT AS extra_segments
FROM (SELECT l.line_id, any_value(l.n) AS n, count(s.segment) AS k FROM lines l LEFT JOIN segs s USING (line_id) GROUP BY l.line_id)""")
def chunk_summary(spark, sf):
    return C.chunk_summary(doc_lines(spark, sf), MAX_LEN)


@register("read_corpus_lines", """
SELECT line AS text, CAST(length(line) AS BIGINT) AS n_chars FROM (
  SELECT regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS line FROM documents) WHERE line <> ''""")
def read_corpus_lines_q(spark, sf):
    path = scratch_path(spark, f"corpus-{uuid.uuid4().hex}")
    lines = doc_lines(spark, sf)
    lines.select(F.to_json(F.struct(F.col("text").alias("aug"))).alias("value")).write.text(path)
    back = read_corpus_lines(spark, path)
    return back.select("text", F.length("text").cast("bigint").alias("n_chars"))


_MASK = "substr(md5('42:' || key || ':' || (i - 1)), 1, 4) < '" + format(int(0.15 * 65536), "04x") + "'"


@register("mlm_rows", _SEG_SQL + f""", keyed AS (SELECT line_id || ':' || seg_idx AS key, string_split(segment, ' ') AS t FROM segs),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || key), key) AS rn, count(*) OVER () AS n FROM keyed)
SELECT CASE WHEN rn <= n - ceil(0.1 * n) THEN 'train' ELSE 'test' END AS split, count(*)::BIGINT AS segments, sum(len(t))::BIGINT AS tokens,
       sum(len(list_filter(range(1, len(t) + 1), lambda i: {_MASK})))::BIGINT AS masked FROM ranked GROUP BY 1""")
def mlm_rows(spark, sf):
    # the split counts and ranks its input: chunk once, then read the segments back
    path = scratch_path(spark, f"segments-{uuid.uuid4().hex}")
    C.chunk_text(doc_lines(spark, sf), MAX_LEN).write.parquet(path)
    seg = spark.read.parquet(path)
    m = C.mlm_rows(seg, 0.15, 42)
    return m.groupBy("split").agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum(F.size("input_tokens")).cast("bigint").alias("tokens"),
        F.sum(F.size(F.filter("labels", lambda x: x.isNotNull()))).cast("bigint").alias("masked"))
