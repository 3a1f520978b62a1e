"""Benchmark decontamination by SimHash windows (operator 5), DataFrame functions only.

1. Texts become arrays of word hashes.  The window width ``w`` holds
   ``2 w - 1 <= SHINGLE``: wherever a shingle of an item stands in a document,
   it covers at least one whole window of the document's grid of adjacent
   ``w``-word windows.  Items give the windows at all their places, documents
   those of the grid.
2. A window's fingerprint is the bitwise majority of its word hashes (mixed
   with the place in the window, so that a repeated word doesn't decide), taken
   for all 64 bits at once on 64-bit integers.
3. Fingerprints meet where one of ``RADIUS + 1`` blocks is equal, which no pair
   within ``RADIUS`` differing bits can avoid; the distance is then checked.
4. A document within ``SIMILARITY`` of an item repeats that share of its
   shingles; a grid window lies in at most ``SHINGLE - w + 1`` of them, which
   says how many windows have to match.  Fewer end a (document, item) here.
5. A candidate (document, item, place) is verified exactly: a whole shingle has
   to stand at that place, and the weight of the item's five-word shingles that
   the document's region repeats, counted with multiplicity, must reach
   ``SIMILARITY`` of the item's weight.

Edits spoil the shingles they touch; every shingle they leave proposes its
place, so no item is lost whatever words were changed, put in or left out.

The benchmark's windows are broadcast when their number is within
``BROADCAST_WINDOWS`` (counted first); a larger benchmark is joined by shuffle.

Defined results: null and empty texts hold no item; items with fewer than five
words have no shingle and are never found (a null item id is an item of its
own); rows equal in id and text share their result and each comes back; an
empty benchmark or table gives no items; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import maybe_member, row_key, stored, table

SHINGLE, SIMILARITY = 5, 0.8
WIDTH = (SHINGLE + 1) // 2  # any shingle covers a whole window of the grid
WIDTHS = (WIDTH,)
RADIUS = 3
BLOCK_BITS = 64 // (RADIUS + 1)
BROADCAST_WINDOWS = 400_000
SEPARATORS = "[^\\p{L}\\p{N}]+"


def word_hashes(text: str = "text") -> Column:
    words = F.array_remove(F.split(F.lower(F.col(text).cast("string")), SEPARATORS, -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _carry(a: Column, b: Column, c: Column) -> Column:
    """Majority of three bits, for 64 bits at once."""
    return a.bitwiseAND(b).bitwiseOR(c.bitwiseAND(a.bitwiseOR(b)))


def majority(h: list[Column]) -> Column:
    """Bitwise majority of 3 hashes."""
    return _carry(*h)


def _fingerprints(df: DataFrame, grid: bool, keys: list[str]) -> DataFrame:
    """``keys, place, fingerprint`` of the windows at every place, or on the grid
    of adjacent windows."""
    starts = F.sequence(F.lit(0), F.size("words") - WIDTH, F.lit(WIDTH if grid else 1))
    found = F.transform(starts, lambda s: F.struct(s.alias("place"), F.slice("words", s + 1, WIDTH).alias("win")))
    rows = df.select(*keys, F.explode(F.when(F.size("words") >= WIDTH, found)).alias("x"))
    return rows.select(*keys, F.col("x.place").alias("place"), majority([F.xxhash64(F.get("x.win", F.lit(j)), F.lit(j)) for j in range(WIDTH)]).alias("fingerprint"))


def _blocks(fingerprint: str = "fingerprint") -> Column:
    mask = F.lit((1 << BLOCK_BITS) - 1)
    return F.posexplode(F.array(*[F.shiftrightunsigned(fingerprint, i * BLOCK_BITS).bitwiseAND(mask).cast("int")
                                  for i in range(RADIUS + 1)])).alias("block", "value")


def _shingles(df: DataFrame, words: str, keys: list[str]) -> DataFrame:
    """``keys, shingle, n`` with multiplicities."""
    last = F.size(words) - SHINGLE
    hashed = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
    return (df.select(*keys, F.explode(F.when(last >= 0, hashed)).alias("shingle"))
              .groupBy(*keys, "shingle").agg(F.count(F.lit(1)).alias("n")))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified pairs ``k, item_key, item_id, similarity`` (``k``: row key)."""
    items = benchmark.select(F.xxhash64("item_id", "text").alias("item_key"), "item_id", word_hashes().alias("words"))
    items = items.where(F.size("words") >= SHINGLE).dropDuplicates(["item_key"])
    items = stored(items.withColumn("length", F.size("words")), "benchmark-items")
    n_windows = items.agg(F.sum(F.col("length") - WIDTH + 1)).first()[0]
    if not n_windows:
        return docs.sparkSession.createDataFrame([], "k binary, item_key long, item_id long, similarity double")
    small = n_windows <= BROADCAST_WINDOWS
    side = F.broadcast if small else (lambda df: df)

    theirs = _fingerprints(items, False, ["item_key", "length"])
    theirs = theirs.select("item_key", "length", F.col("place").alias("item_place"), F.col("fingerprint").alias("item_fingerprint"), _blocks())
    theirs = theirs.withColumnsRenamed({"block": "item_block", "value": "item_value"})
    texts = docs.select(row_key().alias("k"), word_hashes().alias("words"))
    ours = _fingerprints(texts, True, ["k"]).select("k", "place", "fingerprint", _blocks())
    # the distance check runs inside the join, so chance meetings of a block are never materialised
    near = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= RADIUS
    meet = (F.col("block") == F.col("item_block")) & (F.col("value") == F.col("item_value")) & near
    hits = ours.join(side(theirs) if small else theirs.hint("shuffle_hash"), meet)
    # 1e-6: the share as a double may lie a little above the whole number it stands for
    shared = F.ceil(F.lit(SIMILARITY) * (F.col("length") - SHINGLE + 1) - 1e-6)
    hits = hits.select("k", "item_key", "length", "place", (F.col("place") - F.col("item_place")).alias("begin"))
    hits = hits.groupBy("k", "item_key", "length").agg(F.collect_set("place").alias("places"), F.collect_set("begin").alias("begins"))
    hits = hits.where(F.size("places") * (SHINGLE - WIDTH + 1) >= shared)
    found = stored(hits.groupBy("k").agg(F.collect_list(F.struct("item_key", "length", "begins")).alias("found")), "benchmark-candidates")

    slack = F.ceil(F.col("length") / 4).cast("int")
    region = F.slice("words", F.greatest(F.col("begin") - slack, F.lit(0)) + 1,
                     F.col("length") + slack + F.least(slack, slack + F.col("begin")))
    keys = ["k", "item_key", "begin"]
    rows = docs.select(row_key().alias("k"), F.col("text").cast("string").alias("text"))
    # words are taken once a document, before its candidates are spread out
    regions = maybe_member(rows, found, "k").dropDuplicates(["k"]).join(found, "k").select("k", word_hashes().alias("words"), "found")
    regions = regions.select("k", "words", F.inline("found")).select("k", "words", "item_key", "length", F.explode("begins").alias("begin"))
    # a place counts where a whole shingle of the item stands
    first, last = F.greatest(F.lit(0), -F.col("begin")), F.col("length") - SHINGLE
    stands = F.exists(F.sequence(first, last), lambda j: F.slice("words", F.col("begin") + j + 1, SHINGLE) == F.slice("item_words", j + 1, SHINGLE))
    regions = regions.join(side(items.select("item_key", F.col("words").alias("item_words"))), "item_key")
    regions = regions.where(F.when(first <= last, stands)).select(*keys, region.alias("region"))
    ours = _shingles(regions, "region", keys)
    theirs = _shingles(items, "words", ["item_key"]).withColumnRenamed("n", "item_n")
    weight = theirs.groupBy("item_key").agg(F.sum("item_n").alias("weight"))
    theirs = theirs.join(side(weight), "item_key")
    common = ours.join(side(theirs), ["item_key", "shingle"])
    similar = common.groupBy(*keys).agg((F.sum(F.least("n", "item_n")) / F.first("weight")).alias("similarity"))
    best = similar.where(F.col("similarity") >= SIMILARITY).groupBy("k", "item_key").agg(F.max("similarity").alias("similarity"))
    return best.join(side(items.select("item_key", "item_id")), "item_key").select("k", "item_key", "item_id", "similarity")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: ``_k`` (row key), ``doc_id``, ``n_items``,
    ``items`` (ids in order), ``contaminated``."""
    hits = benchmark_hits(docs, benchmark)
    per_doc = hits.groupBy(F.col("k").alias("_k")).agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("ids"))
    out = docs.select(row_key().alias("_k"), F.col("doc_id").cast("long").alias("doc_id")).join(per_doc, "_k", "left")
    return out.select("_k", "doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), F.lit("")).alias("items"),
                      F.col("n_items").isNotNull().alias("contaminated"))


def op5_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_k")


# Every shared shingle proposes a place; regions are verified as above.
_WORDS = "list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
HITS_SQL = f"""
dw AS (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, {_WORDS.format(t='text')} AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT doc_id, p, w[p:p + {SHINGLE - 1}] AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {SHINGLE - 1})) AS p FROM dw)),
iss AS (SELECT item_id, p, n, w[p:p + {SHINGLE - 1}] AS s FROM (SELECT item_id, w, len(w) AS n, unnest(generate_series(1, len(w) - {SHINGLE - 1})) AS p FROM iw)),
ic AS (SELECT item_id, s, count(*) AS c, any_value(n) AS n FROM iss GROUP BY item_id, s),
it AS (SELECT item_id, sum(c) AS weight FROM ic GROUP BY item_id),
cand AS (SELECT DISTINCT d.doc_id, i.item_id, i.n, d.p - i.p AS b FROM ds d JOIN iss i ON d.s = i.s),
reg AS (
  SELECT c.doc_id, c.item_id, c.b, d.s, count(*) AS c FROM cand c JOIN ds d ON d.doc_id = c.doc_id
   AND d.p >= greatest(c.b - ceil(c.n / 4.0), 0) + 1 AND d.p + {SHINGLE - 1} <= c.b + c.n + ceil(c.n / 4.0)
  GROUP BY ALL),
sim AS (SELECT r.doc_id, r.item_id, r.b, sum(least(r.c, i.c)) / any_value(t.weight) AS similarity
        FROM reg r JOIN ic i ON i.item_id = r.item_id AND i.s = r.s JOIN it t ON t.item_id = r.item_id GROUP BY ALL),
hits AS (SELECT DISTINCT doc_id, item_id FROM sim WHERE similarity >= {SIMILARITY})"""
ORACLE_SQL = f"""WITH {HITS_SQL}
SELECT d.doc_id, coalesce(h.n, 0)::BIGINT AS n_items, coalesce(h.items, '') AS items, h.n IS NOT NULL AS contaminated
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM hits GROUP BY doc_id) h
  ON h.doc_id = d.doc_id"""

QUERIES = {"op5_simhash_windows": op5_simhash_windows}
ORACLE = {"op5_simhash_windows": ORACLE_SQL}
