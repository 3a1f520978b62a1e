"""Source divergence audit (operator 11).

1. Texts become terms (runs of letters and of characters beyond ASCII, only
   A-Z lower-cased).  ``CountVectorizer`` with ``minDF`` and the largest integer
   as ``vocabSize`` keeps each language's terms and makes exact sparse document
   vectors.  All languages share one fit: a term carries its language in front,
   and a document has one language, so document frequencies and vocabularies are
   those of each language alone.
2. The sparse vectors are summed by (language, source), in the tasks first: as a
   summarizer does, but without a dense vector per group.
3. Group vectors are cut into blocks of ``BLOCK`` terms.  In a block every pair
   of sources adds up ``|p - q|``: where a source lacks a term its share is the
   group's smallest, so only the terms it has are corrected.  Block sums are
   added up over the blocks.  Shares are whole numbers (parts of 10^9), all
   arithmetic is exact.
4. The terms a source has more of than its language: each block passes on its
   ``TOP`` best of a source (and their ties), the best of all blocks are ranked.

``CountVectorizer`` holds its vocabulary in the driver and in every executor.
So it is fitted in slices of the term space with at most about ``MAX_TERMS``
kept terms each; how many slices are needed is estimated from one of
``SAMPLE_SHARE`` documents.  The result doesn't depend on it.
The number of sources of a language shows in the result's size (all pairs) and
in a block (``BLOCK`` numbers per source).

Defined results: null text, language and source count as ''; every group that
occurs has its pairs, also without terms (value 0 where the language keeps no
term); repeated rows count each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.llm.common import column, stored, table

MIN_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
MAX_VOCABULARY = 2**31 - 1
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MARK = "\u0001"  # between language and term; no term holds it
MAX_TERMS = 1_000_000
SAMPLE_SHARE = 16
BLOCK = 512
SUMMED = "lang string, source string, term long, n long"
EVALUATED = "lang string, source string, other string, term long, value long"


def _low(text: Column) -> Column:
    """Only A-Z in lower case (``lower`` where a text has nothing else to lower)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def _tag() -> Column:
    return F.concat(F.hex("lang"), F.lit(MARK))


def marked_texts(docs: DataFrame) -> DataFrame:
    """``lang, source, marked`` (terms with their language, in hex, in front,
    between spaces).

    Whole texts are lowered and marked before they are cut, so nothing is done
    term by term."""
    lang, source, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text"))
    out = docs.select(lang.alias("lang"), source.alias("source"), text.alias("text"))
    marked = F.concat(_tag(), F.regexp_replace(_low(F.col("text")), F.lit(SEPARATORS), F.concat(F.lit(" "), _tag())))
    return out.select("lang", "source", marked.alias("marked"), F.length("text").alias("size"), F.xxhash64("text").alias("hash"))


def _with_words(marked: DataFrame) -> DataFrame:
    words = F.array_remove(F.split("marked", " ", -1), _tag())
    return marked.select("lang", "source", words.alias("words"), "size", "hash")


def documents_of(docs: DataFrame) -> DataFrame:
    """``lang, source, words`` (terms with their language in front)."""
    return _with_words(marked_texts(docs))


def _part(words: Column | str, parts: int, part: int) -> Column:
    return F.filter(words, lambda w: F.pmod(F.xxhash64(w), F.lit(parts)) == part)


def slices_needed(rows: DataFrame, min_docs: int, max_terms: int) -> int:
    """Into how many slices the term space is cut (0: no term can be kept).

    Every kept term stands in ``min_docs`` documents, which bounds their number
    by the text's size; a large table is looked at in one of ``SAMPLE_SHARE``
    documents: at least ``seen`` of the kept terms stand in two of those."""
    size = rows.agg(F.sum((F.col("size") + 1) / 2).alias("n")).first().n or 0
    if size < min_docs:
        return 0
    if size / min_docs <= max_terms:
        return 1
    q = 1 - 1 / SAMPLE_SHARE
    seen = 1 - q ** min_docs - min_docs * (1 - q) * q ** (min_docs - 1)
    few = rows.where(F.pmod("hash", F.lit(SAMPLE_SHARE)) == 0).select(F.explode(F.array_distinct("words")).alias("w"))
    twice = few.groupBy("w").agg(F.count(F.lit(1)).alias("d")).where("d > 1").count()
    return max(1, math.ceil(twice / max(seen, 0.01) / max_terms))


def _group_sums(vectors: DataFrame) -> DataFrame:
    """Sums of the sparse vectors by (language, source)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = pa.StructArray.from_arrays([column(batch, "lang"), column(batch, "source")], ["lang", "source"])
            names = sorted(set((r["lang"], r["source"]) for r in groups.to_pylist()))
            place = {g: i for i, g in enumerate(names)}
            group = np.fromiter((place[r["lang"], r["source"]] for r in groups.to_pylist()), np.int64, batch.num_rows)
            vec = column(batch, "vector")
            indices, values = pc.struct_field(vec, "indices"), pc.struct_field(vec, "values")
            sizes = np.asarray(pc.list_value_length(indices)).astype(np.int64)
            term = np.asarray(indices.flatten()).astype(np.int64)
            width = int(term.max()) + 1 if len(term) else 1
            key, back = np.unique(np.repeat(group, sizes) * width + term, return_inverse=True)
            n = np.bincount(back, weights=np.asarray(values.flatten()), minlength=len(key))
            of = key // width
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i][k] for i in of.tolist()], pa.string()) for k in (0, 1)]
                + [pa.array(key % width), pa.array(n.astype(np.int64))], ["lang", "source", "term", "n"])

    parts = vectors.select("lang", "source", "vector").mapInArrow(run, SUMMED)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def group_vectors(docs: DataFrame, min_docs: int = MIN_DOCS, max_terms: int = MAX_TERMS, slices: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts of kept terms ``lang, source, term, n`` and the vocabulary
    ``lang, term, word`` (``term``: a number)."""
    spark = docs.sparkSession
    # read by the estimate, the fit and the transform of every slice; a string a
    # document is cheaper to write, read and pass over than an array of its terms
    rows = _with_words(stored(marked_texts(docs), "divergence-terms"))
    n_slices = slices_needed(rows, min_docs, max_terms) if slices is None else slices
    rows = rows.select("lang", "source", "words")
    sums, words, first = [], [], 0
    for i in range(n_slices):
        some = rows if n_slices == 1 else rows.withColumn("words", _part("words", n_slices, i))
        model = CountVectorizer(inputCol="words", outputCol="vector", minDF=min_docs, vocabSize=MAX_VOCABULARY).fit(some)
        vocabulary = model.vocabulary  # about max_terms words
        if not vocabulary:
            continue
        vectors = model.transform(some)
        sums.append(stored(_group_sums(vectors).withColumn("term", F.col("term") + first), "divergence-sums"))
        own = pa.table({"term": np.arange(first, first + len(vocabulary)), "tagged": pa.array(vocabulary, pa.string())})
        tagged = spark.createDataFrame(own)
        lang, word = F.unhex(F.substring_index("tagged", MARK, 1)).cast("string"), F.substring_index("tagged", MARK, -1)
        words.append(stored(tagged.select(lang.alias("lang"), "term", word.alias("word")), "divergence-words"))
        first += len(vocabulary)
    if not sums:
        return spark.createDataFrame([], SUMMED), spark.createDataFrame([], "lang string, term long, word string")
    return reduce(DataFrame.union, sums), reduce(DataFrame.union, words)


def share(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * kept))``,
    in two steps so that no product leaves 64 bits."""
    d = total + SMOOTHING * kept
    whole, rest = np.divmod(np.asarray(count, np.int64) + SMOOTHING, d)
    high, rest = np.divmod(rest * 100_000, d)
    return 1 + whole * SCALE + high * 10_000 + rest * 10_000 // d


def evaluate_block(source: list[str | None], term: np.ndarray, n: np.ndarray, top: int = TOP) -> tuple[list, list]:
    """One block of one language: sums of ``|p - q|`` for all pairs of sources,
    and each source's best terms.  Rows with term -1 hold totals of a source (of
    the language where the source is null), the one with -2 the kept terms."""
    total = {s: int(v) for s, t, v in zip(source, term.tolist(), n.tolist()) if t == -1}
    kept = int(n[term == -2][0])
    whole = total.pop(None)
    names = sorted(total)
    real = term >= 0
    place = {s: i for i, s in enumerate(names)}
    row = np.array([place[source[i]] for i in np.flatnonzero(real).tolist()], np.int64)
    ids, col = np.unique(term[real], return_inverse=True)
    count = np.zeros((len(names), len(ids)), np.int64)
    count[row, col] = n[real]
    p = np.stack([share(c, total[s], kept) for s, c in zip(names, count)])
    least = np.array([int(share(np.zeros(1), total[s], kept)[0]) for s in names])
    has = count > 0
    # |least of one - p| over all terms of another, from the terms the other has
    at = np.nonzero(has)
    begin = np.concatenate(([0], np.cumsum(has.sum(1))))
    pairs = []
    for i, s in enumerate(names):
        far = np.concatenate(([0], np.cumsum(np.abs(least[i] - p[at]))))
        base = far[begin[1:]] - far[begin[:-1]] + (len(ids) - has.sum(1)) * np.abs(least[i] - least)
        own = p[:, has[i]]
        value = base + (np.abs(p[i, has[i]] - own) - np.abs(least[i] - own)).sum(1)
        pairs += [(s, names[j], v) for j, v in enumerate(value.tolist()) if j != i]
    q = share(count.sum(0), whole, kept)
    best = []
    for i, s in enumerate(names):
        more = np.flatnonzero(has[i] & (p[i] > q))
        value = p[i, more] - q[more]
        if len(value) > top:
            keep = value >= np.partition(value, len(value) - top)[len(value) - top]
            more, value = more[keep], value[keep]
        best += [(s, t, v) for t, v in zip(ids[more].tolist(), value.tolist())]
    return pairs, best


_EVALUATED_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("term", pa.int64()), ("value", pa.int64())])


def _evaluate(key: tuple, t: pa.Table) -> pa.Table:
    pairs, best = evaluate_block(t["source"].to_pylist(), np.asarray(t["term"]), np.asarray(t["n"]))
    rows = [(s, o, None, v) for s, o, v in pairs] + [(s, None, x, v) for s, x, v in best]
    s, o, x, v = zip(*rows) if rows else ((), (), (), ())
    return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(rows), pa.string()), pa.array(s, pa.string()), pa.array(o, pa.string()),
                                 pa.array(x, pa.int64()), pa.array(v, pa.int64())], schema=_EVALUATED_ARROW)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, max_terms: int = MAX_TERMS, slices: int | None = None) -> DataFrame:
    """``lang, source, part, item, value, rank``: every other source of the
    language by divergence (``pair``), and the ``top`` terms a source has more
    of than its language (``term``)."""
    counts, words = group_vectors(docs, min_docs, max_terms, slices)
    groups = documents_of(docs).select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = stored(groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "divergence-groups")
    none, block = F.lit(None).cast("string").alias("source"), F.floor(F.col("term") / BLOCK).alias("block")
    blocks = words.select("lang", block).distinct()
    whole = groups.groupBy("lang").agg(F.sum("n").alias("n")).select("lang", none, F.lit(-1).cast("long").alias("term"), "n")
    kept = words.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", none, F.lit(-2).cast("long").alias("term"), "n")
    marks = groups.select("lang", "source", F.lit(-1).cast("long").alias("term"), "n").union(whole).union(kept)
    columns = ["lang", "block", "source", "term", "n"]
    rows = counts.select("lang", block, "source", "term", "n").union(marks.join(blocks, "lang").select(*columns))
    found = stored(rows.groupBy("lang", "block").applyInArrow(_evaluate, EVALUATED), "divergence-blocks")

    sums = found.where(F.col("other").isNotNull()).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("other")), "lang").where("source <> other")
    pair = both.join(sums, ["lang", "source", "other"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    term = found.where(F.col("term").isNotNull()).join(words.select("term", "word"), "term").select(
        "lang", "source", F.lit("term").alias("part"), F.col("word").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [pair.withColumn("rank", F.row_number().over(order)), term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)]
    return ranked[0].union(ranked[1])


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT r, lang, source, term, count(*) AS n FROM t GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term HAVING count(*) >= {MIN_DOCS}),
size AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT c.lang, c.source, c.term, sum(c.n)::HUGEINT AS n FROM c JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT g.lang, g.source, coalesce(sum(o.n), 0)::HUGEINT AS n FROM g LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source GROUP BY ALL),
p AS (
  SELECT tot.lang, tot.source, k.term, coalesce(o.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(o.n, 0) + {SMOOTHING})) // (tot.n + {SMOOTHING} * s.v) AS p,
         1 + ({SCALE}::HUGEINT * (k.n + {SMOOTHING})) // (s.n + {SMOOTHING} * s.v) AS q
  FROM tot JOIN size s ON s.lang = tot.lang JOIN kept k ON k.lang = tot.lang
  LEFT JOIN own o ON o.lang = tot.lang AND o.source = tot.source AND o.term = k.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term)
WHERE rank <= {TOP}"""

QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLE = {"op11_source_divergence": ORACLE_SQL}
