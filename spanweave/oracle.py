"""DuckDB SQL for the correctness oracle.

Each registered query has an independent SQL statement over the driver's
pre-registered tables.  The derived views of ``sources.fixtures`` are written
once here as CTE text; they use a window for token offsets where the Spark side
uses array functions, so the two implementations share no logic.

Control characters in literals are real characters, built in Python so both
engines receive the same bytes.
"""

from __future__ import annotations

from spanweave.sources.fixtures import TYPE_CASE

_HASH = "md5(concat('pred:', CAST(doc_id AS VARCHAR), ':', CAST(s AS VARCHAR)))"


def docs_cte(garbled: bool = False, name: str = "docs") -> str:
    src, dst = "\n\t\r", "   "
    if garbled:
        src, dst = src + "w", dst + "☆"
    return f"{name} AS (SELECT doc_id, lang, translate(text, '{src}', '{dst}') AS text FROM documents)"


def cand_ctes(garbled: bool = False) -> str:
    """``docs, tok, cand, gold, pred`` CTEs (no leading WITH)."""
    return f"""{docs_cte(garbled)},
tok AS (
  SELECT doc_id, pos, tok,
         CAST(coalesce(sum(length(tok) + 1) OVER (PARTITION BY doc_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS tok,
               generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM docs)),
cand AS (
  SELECT doc_id, CAST(pos AS BIGINT) AS pos, off AS s, CAST(off + length(name) AS BIGINT) AS e, name,
         {TYPE_CASE.format(n='name')} AS type
  FROM (SELECT doc_id, pos, off, rtrim(tok, '.,;:!?|') AS name FROM tok)
  WHERE length(name) >= 4),
gold AS (SELECT * FROM cand WHERE regexp_matches(name, '^[A-Z]')),
pred AS (
  SELECT doc_id, CASE WHEN substr(h, 3, 1) = '2' THEN 'person' ELSE type END AS type, s,
         CASE WHEN substr(h, 2, 1) = '1' THEN e - 1 ELSE e END AS e, name
  FROM (SELECT *, {_HASH} AS h FROM gold) WHERE substr(h, 1, 1) <> '0'
  UNION ALL
  SELECT doc_id, type, s, e, name
  FROM (SELECT *, {_HASH} AS h FROM cand WHERE NOT regexp_matches(name, '^[A-Z]'))
  WHERE substr(h, 1, 1) = 'f' AND substr(h, 2, 1) < '4')"""


def split_cte(name: str = "splits", seed: int = 42) -> str:
    """Exact 80/10/10 split of documents by the seeded md5 order."""
    return f"""{name} AS (
  SELECT doc_id,
         CASE WHEN rn <= floor(0.8 * n) THEN 'train'
              WHEN rn <= floor(0.8 * n) + floor(0.1 * n) THEN 'validation'
              ELSE 'test' END AS split
  FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('{seed}:', CAST(doc_id AS VARCHAR))), doc_id) AS rn,
               count(*) OVER () AS n FROM documents))"""


MATCH_CTE = """m AS (
  SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.type, p.type) AS type,
         coalesce(g.s, p.s) AS s, coalesce(g.e, p.e) AS e,
         CASE WHEN g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL THEN 'tp'
              WHEN g.doc_id IS NOT NULL THEN 'fn' ELSE 'fp' END AS outcome
  FROM (SELECT DISTINCT doc_id, type, s, e FROM gold) g
  FULL OUTER JOIN (SELECT DISTINCT doc_id, type, s, e FROM pred) p
    ON g.doc_id = p.doc_id AND g.type = p.type AND g.s = p.s AND g.e = p.e)"""

TYPE_COUNTS_CTE = """tc AS (
  SELECT type, CAST(count(*) FILTER (WHERE outcome = 'tp') AS BIGINT) AS tp,
         CAST(count(*) FILTER (WHERE outcome IN ('tp', 'fp')) AS BIGINT) AS n_pred,
         CAST(count(*) FILTER (WHERE outcome IN ('tp', 'fn')) AS BIGINT) AS support
  FROM m GROUP BY type)"""


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
