"""Line deduplication by a log-template tree (operator 2), DataFrame functions only.

A line is reduced to its tokens (runs of blanks are one separator); tokens with
a digit are masked.  The tree has a fixed depth: a leaf is the token count and
the first ``DEPTH`` masked tokens.  Inside a leaf a place is looked at as a
whole, over its distinct lines: the most frequent value of every place makes
the leaf's template, and every line that agrees with it in ``SHARE`` of the
places belongs to it; where such a line differs stands a variable field,
however often its values repeat.  The lines that are left go on as a leaf of
their own.  A leaf without two lines of its template is split at the place with
the fewest values, where two or more lines share a value on average (several
kinds of lines are mixed there); a leaf that can't be split is done.  So every
round takes lines away or splits leaves, until no leaf is left.

Lines of which fewer tokens than ``SHARE`` are left by the masking (rows of
numbers) say too little to stand for each other: they are equal only as written.
A template recurs when its lines stand in ``MIN_DOCS`` documents (short
templates, under ``SHORT`` tokens: ``SHORT_DOCS``).  Of a recurring template
the first line (by document id, then place) stays and all others are dropped.

Texts are masked once; lines are written with their masked text.  Identical
masked lines are folded before any token is looked at, tokens are only spread
out for leaves with several distinct lines, and every aggregate combines on the
map side.  What is decided is decided per distinct line; lines that stand more
than ``HOT`` times (at most one in ``HOT`` of all lines) are found by a
broadcast of those, so no task gets all of a common line.

Defined results: lines under ``MIN_TOKENS`` tokens (blank ones too) are never
dropped; null and empty texts come back as they are; rows equal in id and text
are one document, and each of them comes back; a null id sorts first; an empty
table stays empty; other columns are ignored by the decision.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import maybe_member, row_key, stored, table

DEPTH, SHARE = 4, 0.8
MIN_DOCS, SHORT, SHORT_DOCS, MIN_TOKENS = 2, 8, 5, 3
HOT = 10_000
OTHER_BLANKS = ("\t", "\r", "\f")
DIGIT_TOKEN = "(^|[ \\n])[^ 0-9\\n]*+[0-9][^ \\n]*+"


def _plain(text: Column) -> Column:
    """Runs of blanks as one space.  Literal searches, which cost little, keep
    the patterns to the texts that need them."""
    other = text.contains(OTHER_BLANKS[0]) | text.contains(OTHER_BLANKS[1]) | text.contains(OTHER_BLANKS[2])
    t = F.when(other, F.translate(text, "".join(OTHER_BLANKS), "   ")).otherwise(text)
    return F.when(t.contains("  "), F.regexp_replace(t, " +", " ")).otherwise(t)


def _masked(text: Column) -> Column:
    """Runs of blanks as one space, tokens with a digit as ``<*>``."""
    t = _plain(text)
    return F.when(text.rlike("[0-9]"), F.regexp_replace(t, DIGIT_TOKEN, "$1<*>")).otherwise(t)


def _bare(m: str, n: str) -> Column:
    """Whether fewer than ``SHARE`` of the tokens are left by the masking."""
    masks = F.size(F.filter(F.split(m, " ", -1), lambda t: t == "<*>"))
    return F.col(m).contains("<*>") & (F.col(n) - masks < F.ceil(F.lit(SHARE) * F.col(n)))


def _lines(docs: DataFrame) -> DataFrame:
    """Lines: ``k, doc_id, pos, n, leaf, lh`` (identity of the masked line, or of
    the line as written where masking leaves too little of it) and ``m``, the
    masked line where it can be of a template with variable fields.  Texts are
    masked whole, below the generator, so that no pushed-down condition repeats
    that work."""
    text = F.col("text").cast("string")
    written = F.when(text.rlike("[0-9]"), F.split(_plain(text), "\n", -1)).otherwise(F.array().cast("array<string>"))
    both = F.arrays_zip(F.split(_masked(text), "\n", -1).alias("m"), written.alias("w"))
    # the key is made below the generator too: above it, every line would hash the whole text again
    whole = docs.select(row_key().alias("k"), F.col("doc_id").cast("long").alias("doc_id"), both.alias("both"))
    lines = whole.select("k", "doc_id", F.posexplode_outer("both").alias("pos", "x"))
    lines = lines.select("k", "doc_id", "pos", F.trim("x.m").alias("m"), F.trim(F.coalesce("x.w", "x.m")).alias("w"))
    n = F.length("m") - F.length(F.replace("m", F.lit(" "))) + 1
    lines = lines.select("*", n.alias("n")).where(F.col("n") >= MIN_TOKENS).withColumn("bare", _bare("m", "n"))
    leaf = F.unhex(F.md5(F.concat_ws(" ", F.col("n").cast("string"), F.substring_index("m", " ", DEPTH))))
    own = F.unhex(F.md5(F.when(F.col("bare"), F.concat(F.lit("raw "), "w")).otherwise(F.concat(F.lit("line "), "m"))))
    return lines.select("k", "doc_id", "pos", "n", leaf.alias("leaf"), own.alias("lh"), F.when(~F.col("bare") & (F.col("n") > DEPTH), F.col("m")).alias("m"))


def _split_leaf(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("/", *[p.cast("string") for p in parts])))


def _round(active: DataFrame) -> DataFrame:
    """One look at every leaf: lines with ``ok`` (they agree with the template)
    and ``matched`` (how many of the leaf do), and where to split the leaf."""
    place = ["leaf", "at"]
    values = active.select("leaf", F.posexplode("tokens").alias("at", "token")).groupBy(*place, "token").agg(F.count(F.lit(1)).alias("c"))
    places = values.groupBy(*place).agg(F.max(F.struct("c", "token"))["token"].alias("mode"), F.count(F.lit(1)).alias("values"), F.sum("c").alias("lines"))
    few = F.when((F.col("values") > 1) & (2 * F.col("values") <= F.col("lines")), F.struct("values", "at"))
    leaves = places.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("at", "mode"))).alias("modes"), F.min(few)["at"].alias("split"))
    joined = active.join(leaves, "leaf")
    agree = F.size(F.filter(F.zip_with("tokens", "modes", lambda t, m: t == m["mode"]), lambda x: x))
    ok = agree >= F.ceil(F.lit(SHARE) * F.size("tokens"))
    judged = joined.select("lh", "leaf", "tokens", "split", ok.alias("ok"))
    matched = judged.groupBy("leaf").agg(F.count_if("ok").alias("matched"))
    return judged.join(matched, "leaf")


def _generalised(lines: DataFrame, distinct: DataFrame) -> DataFrame | None:
    """Templates of lines with variable fields: ``lh, template``."""
    wide = stored(distinct.where("general").groupBy("leaf").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("leaf"), "wide-leaves")
    body = maybe_member(lines.where(F.col("m").isNotNull()).select("lh", "leaf", "m"), wide, "leaf").join(wide, "leaf", "left_semi").groupBy("lh", "leaf").agg(F.min("m").alias("m"))
    active = stored(body.select("lh", "leaf", F.split("m", " ", -1).alias("tokens")), "wide-lines")
    found = []
    while not active.isEmpty():
        judged = stored(_round(active), "judged-lines")
        found.append(judged.where("ok and matched > 1").select("lh", _split_leaf(F.lit("template"), F.hex("leaf")).alias("template")))
        left = judged.where("not (ok and matched > 1) and (matched > 1 or split is not null)")
        leaf = F.when(F.col("matched") > 1, _split_leaf(F.hex("leaf"), F.lit("rest"))).otherwise(
            _split_leaf(F.hex("leaf"), F.col("split"), F.try_element_at("tokens", F.col("split") + 1)))
        left = stored(left.select("lh", leaf.alias("leaf"), "tokens"), "leaf-lines")
        several = left.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("leaf")
        active = stored(left.join(several, "leaf", "left_semi"), "wide-lines")
    return reduce(DataFrame.union, found) if found else None


def _of_lines(lines: DataFrame, decided: DataFrame) -> DataFrame:
    """Lines with what was decided for their ``lh`` (``decided`` has ``rows``, how
    often the line stands)."""
    hot = F.broadcast(decided.where(F.col("rows") > HOT).drop("rows"))
    common = lines.join(hot, "lh")
    return common.union(lines.join(hot.select("lh"), "lh", "left_anti").join(decided.where(F.col("rows") <= HOT).drop("rows"), "lh"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """Lines to drop: ``k, pos`` (``k`` is the document's row key)."""
    lines = stored(_lines(docs), "masked-lines")
    light = lines.drop("m")
    distinct = stored(lines.groupBy("lh").agg(F.first("leaf").alias("leaf"), F.max(F.col("m").isNotNull()).alias("general"),
                                              F.count(F.lit(1)).alias("rows")), "distinct-lines")
    general = _generalised(lines, distinct)
    # a line that stands alone and is of no template can't recur
    if general is None:
        decided = distinct.where("rows > 1").select("lh", "rows", F.col("lh").alias("template"))
    else:
        decided = distinct.select("lh", "rows").join(general, "lh", "left").where("rows > 1 or template is not null") \
            .select("lh", "rows", F.coalesce("template", "lh").alias("template"))
    decided = stored(decided, "line-candidates")
    some = stored(_of_lines(light.select("k", "doc_id", "pos", "n", "lh"), decided), "line-templates")
    first = F.min(F.struct("doc_id", "k", "pos")).alias("first")
    per_doc = some.groupBy("template", "k").agg(first, F.first("n").alias("n"))
    recurring = (per_doc.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("first").alias("first"), F.first("n").alias("n"))
                 .where(F.col("docs") >= F.when(F.col("n") < SHORT, SHORT_DOCS).otherwise(MIN_DOCS)).select("template", "first"))
    drop = stored(decided.join(recurring, "template").select("lh", "rows", "first"), "recurring-lines")
    return _of_lines(some.select("k", "pos", "lh"), drop).where((F.col("k") != F.col("first.k")) | (F.col("pos") != F.col("first.pos"))).select("k", "pos")


def drop_templates(docs: DataFrame) -> DataFrame:
    """Documents without the recurring lines: the input's columns with the new
    ``text``, and ``lines_kept``, ``lines_dropped``."""
    drops = dropped_lines(docs).groupBy(F.col("k").alias("_sw_k")).agg(F.collect_set("pos").alias("_sw_drop"))
    names = [c for c in docs.columns if c not in ("lines_kept", "lines_dropped")]
    parts = F.split(F.col("text").cast("string"), "\n", -1)
    out = docs.withColumn("_sw_k", row_key()).join(drops, "_sw_k", "left")
    out = out.withColumn("_sw_parts", F.when(F.col("_sw_drop").isNotNull(), parts))
    out = out.withColumn("_sw_kept", F.filter(F.col("_sw_parts"), lambda _, i: ~F.array_contains(F.col("_sw_drop"), i)))
    same = F.col("_sw_drop").isNull()
    text = F.when(same, F.col("text")).otherwise(F.array_join("_sw_kept", "\n"))
    kept = F.when(F.col("text").isNull(), 0).when(same, F.size(parts)).otherwise(F.size("_sw_kept"))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in names], kept.cast("long").alias("lines_kept"),
                      F.coalesce(F.array_size("_sw_drop"), F.lit(0)).cast("long").alias("lines_dropped"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_templates(docs).select("doc_id", "text", "lines_kept", "lines_dropped")


SQL_ROUNDS = 4  # as many as the SQL writes out; the operator goes on until no leaf is left


def _round_sql(i: int) -> str:
    """Leaves of round ``i`` (``act{i}``: leaf, n, m, toks) judged; ``act{i + 1}``: what is left."""
    return f"""
val{i} AS (SELECT leaf, spot, token, count(*) AS c FROM (
  SELECT leaf, unnest(toks) AS token, generate_subscripts(toks, 1) AS spot FROM act{i}) GROUP BY ALL),
plc{i} AS (SELECT leaf, spot, max({{'c': c, 'token': token}}).token AS mode, count(*) AS vals, sum(c) AS lines FROM val{i} GROUP BY leaf, spot),
lf{i} AS (SELECT leaf, list(mode ORDER BY spot) AS modes, min(CASE WHEN vals > 1 AND 2 * vals <= lines THEN {{'v': vals, 's': spot}} END).s AS cut FROM plc{i} GROUP BY leaf),
jd{i} AS (
  SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY leaf) AS matched FROM (
    SELECT a.*, l.cut, len(list_filter(list_zip(a.toks, l.modes), lambda z: z[1] = z[2])) >= ceil({SHARE} * len(a.toks)) AS ok FROM act{i} a JOIN lf{i} l USING (leaf))),
act{i + 1} AS (
  SELECT leaf, m, toks FROM (
    SELECT *, count(*) OVER (PARTITION BY leaf) AS lines FROM (
      SELECT CASE WHEN matched > 1 THEN leaf || '/rest' ELSE leaf || '/' || cut || '=' || toks[cut] END AS leaf, m, toks
      FROM jd{i} WHERE NOT (ok AND matched > 1) AND (matched > 1 OR cut IS NOT NULL))) WHERE lines > 1),"""


_LINES_SQL = f"""
lines AS (
  SELECT doc_id, pos, w, m, toks, len(toks) AS n, len(list_filter(toks, lambda t: t = '<*>')) AS masks FROM (
    SELECT doc_id, pos, w, m, string_split(m, ' ') AS toks FROM (
      SELECT doc_id, pos, w, regexp_replace(w, '(^| )[^ 0-9]*[0-9][^ ]*', '\\1<*>', 'g') AS m FROM (
        SELECT doc_id, pos, trim(regexp_replace(line, '[ \\t\\r\\f]+', ' ', 'g')) AS w
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))))
),
deep AS (
  SELECT doc_id, pos, m, toks, n, masks > 0 AND n - masks < ceil({SHARE} * n) AS bare,
         CASE WHEN masks > 0 AND n - masks < ceil({SHARE} * n) THEN 'raw ' || w ELSE 'line ' || m END AS own,
         n || ' ' || array_to_string(toks[1:{DEPTH}], ' ') AS leaf
  FROM lines WHERE n >= {MIN_TOKENS}
),
act0 AS (SELECT leaf, m, toks FROM (SELECT *, count(*) OVER (PARTITION BY leaf) AS lines FROM (
  SELECT DISTINCT leaf, m, toks FROM deep WHERE NOT bare AND n > {DEPTH})) WHERE lines > 1),"""
_LINES_SQL += "".join(_round_sql(i) for i in range(SQL_ROUNDS)) + """
tpl AS (""" + " UNION ALL ".join(f"SELECT m, 'template ' || leaf AS template FROM jd{i} WHERE ok AND matched > 1" for i in range(SQL_ROUNDS)) + """),
named AS (SELECT d.doc_id, d.pos, d.n, coalesce(p.template, d.own) AS template FROM deep d LEFT JOIN tpl p ON NOT d.bare AND d.m = p.m),
""" + f"""rec AS (
  SELECT template, min(doc_id) AS first_doc FROM named GROUP BY template
  HAVING count(DISTINCT doc_id) >= CASE WHEN min(n) < {SHORT} THEN {SHORT_DOCS} ELSE {MIN_DOCS} END
),
firsts AS (SELECT r.template, r.first_doc, min(n.pos) AS first_pos FROM rec r JOIN named n ON n.template = r.template AND n.doc_id = r.first_doc GROUP BY ALL),
gone AS (SELECT n.doc_id, n.pos FROM named n JOIN firsts f USING (template) WHERE n.doc_id <> f.first_doc OR n.pos <> f.first_pos),
kept_lines AS (
  SELECT d.doc_id, unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) - 1 AS pos FROM documents d
)"""

ORACLE_SQL = f"""WITH {_LINES_SQL}
SELECT d.doc_id, CASE WHEN coalesce(g.n, 0) = 0 THEN d.text ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n, 0)::BIGINT AS lines_kept, coalesce(g.n, 0)::BIGINT AS lines_dropped
FROM documents d
LEFT JOIN (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, count(*) AS n FROM kept_lines l
           LEFT JOIN gone x ON x.doc_id = l.doc_id AND x.pos = l.pos WHERE x.doc_id IS NULL GROUP BY l.doc_id) k ON k.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id"""

QUERIES = {"op2_line_templates": op2_line_templates}
ORACLE = {"op2_line_templates": ORACLE_SQL}
