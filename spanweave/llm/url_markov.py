"""URL filter by a character language-model ratio (operator 13).

1. Host and path of a URL meet a small list of rules; the longest rule that
   fits decides.
2. Two smoothed variable-order Markov models are counted over all URLs that a
   rule decides, one for allowed and one for blocked ones: contexts of no to
   ``ORDER`` bytes, each mixed with the next shorter one by the number of
   different bytes seen after it (Witten-Bell), so the longest context that was
   seen has most to say.  URLs whose hash falls into the last of ``FOLDS`` parts
   are left out.
3. The score is the difference of the log likelihoods divided by the length
   (the end counts as one character).  The threshold is calibrated on the URLs
   left out: the cut with the least mean error of both kinds.
4. A URL that no rule decides is allowed from the threshold on.

Bytes fall into ``CLASSES`` classes (ASCII letters without case, digits, the
usual signs, all others), so a model has at most ``CLASSES ** (ORDER + 1)``
counts whatever the input; they are added up in the tasks and once more in a
shuffle, and grow with the input up to that bound.  Nothing else is gathered.
All passes are narrow; only ``page_id`` and ``url`` are read.

Defined results: a null URL counts as empty; a URL without ``://`` has an empty
host and path and no rule; repeated rows and null ids are kept, one row each;
without URLs of both kinds the models say nothing and every URL without a rule
is allowed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from spanweave.llm.common import binary_parts, column, table, text_slices

# Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ORDER = 3
SIGNS = "./-:?=&#_%"
CLASSES = 1 + 26 + 10 + len(SIGNS) + 1  # boundary, letters, digits, signs, any other byte
FOLDS = 5
BINS = 4096  # of the calibration's histogram
RANGE = 8.0  # scores beyond it (nats a character) share the last bin


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(_after(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    """What follows the first ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def decided(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, url, host, path, rule, decision`` (the longest fitting rule's;
    null without one)."""
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    out = out.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = verdict = None
    for decision, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    none = F.lit(None).cast("string")
    return out.select("*", (none if rule is None else rule).alias("rule"), (none if verdict is None else verdict).alias("decision"))


def _byte_classes() -> np.ndarray:
    t = np.full(256, CLASSES - 1, np.int64)
    for i in range(26):
        t[ord("a") + i] = t[ord("A") + i] = 1 + i
    for i in range(10):
        t[ord("0") + i] = 27 + i
    for i, c in enumerate(SIGNS):
        t[ord(c)] = 37 + i
    return t


_CLASS = _byte_classes()


def context_codes(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all (context, byte) places of the URLs, the end included, and
    how many each URL has."""
    data, at = binary_parts(urls)
    size = np.diff(at)
    n = size + 1
    # every URL after ORDER boundary marks, with one behind
    ends = np.cumsum(size + ORDER + 1)
    begin = ends - n
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    inside = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
    flat[inside] = _CLASS[data[int(at[0]):int(at[-1])]]
    place = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
    code = np.zeros(len(place), np.int64)
    for back in range(ORDER, -1, -1):
        code = code * CLASSES + flat[place - back]
    return code, n


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of every code from the counts of the longest contexts."""
    n = counts.reshape((CLASSES,) * (ORDER + 1)).astype(np.float64)
    lower = np.full(CLASSES, 1.0 / CLASSES)
    for order in range(ORDER + 1):
        c = n.sum(axis=tuple(range(ORDER - order))) if order < ORDER else n
        seen = c.sum(-1, keepdims=True)
        kinds = np.maximum((c > 0).sum(-1, keepdims=True), 1)  # a context never seen is its shorter one
        lower = (c + kinds * lower) / (seen + kinds)
    return np.log(lower).ravel()


@dataclass
class Ratio:
    """Difference of two models' log probabilities, and the calibrated threshold."""
    table: np.ndarray
    threshold: float

    def scores(self, urls: pa.Array) -> np.ndarray:
        code, n = context_codes(urls)
        at = np.cumsum(n) - n
        return np.add.reduceat(self.table[code].astype(np.float64), at) / n if len(n) else np.zeros(0)


def _left_out(urls: str = "url") -> Column:
    return F.pmod(F.xxhash64(urls), F.lit(FOLDS)) == FOLDS - 1


def count_contexts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every code among allowed and blocked URLs (``url, decision``)."""
    size = CLASSES ** (ORDER + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, urls in text_slices(batches, "url"):
            code, n = context_codes(urls)
            blocked = np.repeat(np.asarray(column(batch, "blocked")).astype(np.int64), n)
            both, count = np.unique(code + blocked * size, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(count.astype(np.int64))], ["code", "n"])

    got = rows.select("url", F.when(F.col("decision") == "block", 1).otherwise(0).alias("blocked")) \
        .mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most 2 x size rows
    counts = np.zeros(2 * size, np.int64)
    counts[np.asarray(got["code"])] = np.asarray(got["n"])
    return counts[:size], counts[size:]


def cut(allowed: np.ndarray, blocked: np.ndarray) -> float:
    """Threshold between two histograms over ``[-RANGE, RANGE]`` with the least
    mean error; the middle of the best cuts, 0 without URLs of both kinds."""
    if not allowed.sum() or not blocked.sum():
        return 0.0
    lost = np.concatenate(([0], np.cumsum(allowed))) / allowed.sum()
    passed = 1 - np.concatenate(([0], np.cumsum(blocked))) / blocked.sum()
    best = np.flatnonzero(np.isclose(lost + passed, (lost + passed).min(), rtol=0, atol=1e-12))
    run = best[:np.argmax(np.diff(best, append=best[-1] + 2) > 1) + 1]  # the first stretch of them
    return (run[0] + run[-1]) / 2 / BINS * 2 * RANGE - RANGE


def train(pages: DataFrame) -> Ratio:
    """Models and threshold from the rows of ``decided`` that have a rule."""
    known = pages.where(F.col("decision").isNotNull())
    allowed, blocked = count_contexts(known.where(~_left_out()))
    if not allowed.sum() or not blocked.sum():
        return Ratio(np.zeros(CLASSES ** (ORDER + 1), np.float32), 0.0)
    ratio = Ratio((log_model(allowed) - log_model(blocked)).astype(np.float32), 0.0)
    scored = score(known.where(_left_out()), ratio)
    at = F.least(F.greatest(F.floor((F.col("score") + RANGE) / (2 * RANGE) * BINS), F.lit(0)), F.lit(BINS - 1))
    histogram = np.zeros((2, BINS), np.int64)
    for r in scored.groupBy(at.alias("bin"), (F.col("decision") == "block").cast("int").alias("blocked")).count().collect():  # 2 x BINS rows
        histogram[r.blocked, r.bin] = r["count"]
    ratio.threshold = cut(*histogram)
    return ratio


def score(rows: DataFrame, ratio: Ratio) -> DataFrame:
    """Rows with their ``score`` (positive: more like the allowed URLs)."""
    names, schema = rows.columns, StructType([*rows.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, urls in text_slices(batches, "url"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratio.scores(urls))], [*names, "score"])

    return rows.mapInArrow(run, schema)


def filtered(pages: DataFrame, rules=RULES) -> DataFrame:
    """Every page with ``host, path, rule, verdict, score``."""
    known = decided(pages, rules)
    ratio = train(known)
    own = F.when(F.col("score") >= ratio.threshold, "allow").otherwise("block")
    return score(known, ratio).select("page_id", "url", "host", "path", "rule", F.coalesce("decision", own).alias("verdict"), "score")


def op13_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op13_url_markov": op13_url_markov}
