"""Document quality from a linear-chain conditional random field over lines (operator 4).

Every line (cut at newlines) has a state, good or bad.  Emissions are linear in
features of the line and of its two neighbours; transitions link neighbouring
states.  Documents' labels are spread to their lines; lines of bad documents
are then relabelled by their own marginals and the field is fitted again, so a
bad document may hold good lines.  A document's score is the length-weighted
mean of its lines' forward-backward marginals, calibrated on the sample.

The field is fitted on at most ``SAMPLE`` labelled documents, those with the
smallest hash of their id among the rows that may be learnt from; scoring is
one narrow pass over all whole texts.  Only text enters a score.

Defined results: null and empty texts are one empty line and get the score the
model gives that; repeated rows and null ids are kept, one row each; a null id
is never held out; null labels aren't learnt from, and of several labels of
one id the smallest counts; without labels of both kinds every score is the
share of good labels (0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import column, table, text_slices
from spanweave.llm.wording import code_points, words

SAMPLE = 3000
FOLDS, THRESHOLD = 5, 0.3
ROUNDS, RELABELS, RIDGE = 100, 2, 1e-3
N_OWN = 14
NEIGHBOUR = (1, 2, 3, 4, 9, 12, 13)  # own features that are also taken from both neighbours
N_FEATURES = N_OWN + 2 * len(NEIGHBOUR)
_PUNCTUATION = ".,;:'\"()-?"

_classes: list[np.ndarray] = []


def _char_classes() -> np.ndarray:
    """Class of each code point: 0 white, 1 lower or uncased letter, 2 upper, 3 digit,
    4 plain punctuation, 5 bar, 6 exclamation mark, 7 other."""
    if not _classes:
        t = np.full(0x110000, 7, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                t[i] = 2 if c.isupper() else 1
            elif c.isspace():
                t[i] = 0
            elif c.isnumeric():
                t[i] = 3
        for c in _PUNCTUATION:
            t[ord(c)] = 4
        t[ord("|")], t[ord("!")] = 5, 6
        _classes.append(t)
    return _classes[0]


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of all lines, line lengths, and where each text's lines begin."""
    per_text = [t.split("\n") for t in texts]
    begin = np.concatenate(([0], np.cumsum([len(x) for x in per_text]))).astype(np.int64)
    lines = [x for ls in per_text for x in ls]
    n = len(lines)
    size = np.fromiter(map(len, lines), np.int64, n)
    cps = code_points("\n".join(lines) + "\n")
    classes = _char_classes()[cps]
    line = np.repeat(np.arange(n), size + 1)
    count = np.bincount(line * 8 + classes, minlength=8 * n).reshape(n, 8).astype(np.float64)
    count[:, 0] -= 1  # the newline
    letters = count[:, 1] + count[:, 2]
    chars = np.maximum(size, 1)
    w, at = words(lines)
    n_words = np.diff(at)
    owner = np.repeat(np.arange(n), n_words)
    order = np.lexsort((w, owner))
    new = np.ones(len(w), bool)
    new[1:] = (w[order][1:] != w[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order], weights=new, minlength=n)
    whole = np.zeros(n, np.uint64)
    np.add.at(whole, owner, w)
    first = np.zeros(n, bool)
    first[begin[:-1]] = True
    x = np.zeros((n, N_FEATURES))
    x[:, 0] = 1
    x[:, 1] = count[:, 2] / np.maximum(letters, 1)
    x[:, 2] = count[:, 7] / chars * 4
    x[:, 3] = count[:, 5] / chars * 8
    x[:, 4] = count[:, 6] / chars * 8
    x[:, 5] = count[:, 3] / chars * 4
    x[:, 6] = letters / chars
    x[:, 7] = np.log1p(size) / 4
    x[:, 8] = np.log1p(n_words) / 4
    x[:, 9] = 1 - distinct / np.maximum(n_words, 1)
    x[:, 10] = letters / np.maximum(n_words, 1) / 8
    x[:, 11] = count[:, 4] / chars * 8
    x[1:, 12] = (whole[1:] == whole[:-1]) & (n_words[1:] > 0) & ~first[1:]
    echo = np.zeros(len(w), bool)  # a word that repeats the one before it in its line
    echo[1:] = (w[1:] == w[:-1]) & (owner[1:] == owner[:-1])
    x[:, 13] = np.bincount(owner, weights=echo, minlength=n) / np.maximum(n_words - 1, 1) * 3
    last = np.zeros(n, bool)
    last[begin[1:] - 1] = True
    for i, f in enumerate(NEIGHBOUR):
        x[1:, N_OWN + 2 * i] = np.where(first[1:], 0, x[:-1, f])
        x[:-1, N_OWN + 2 * i + 1] = np.where(last[:-1], 0, x[1:, f])
    return x, size, begin


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


class Chains:
    """Lines of many documents, laid out step by step, longest document first."""

    def __init__(self, begin: np.ndarray):
        length = np.diff(begin)
        self.order = np.argsort(-length, kind="stable")
        starts, length = begin[:-1][self.order], length[self.order]
        self.steps = []
        alive, t = len(length), 0
        while alive:
            self.steps.append(starts[:alive] + t)
            t += 1
            alive = int(np.searchsorted(-length, -t, "left"))

    def marginals(self, emission: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, the summed pair marginals, log Z per document
        (in layout order).  ``emission``: score of good against bad."""
        n = len(emission)
        fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
        pairs = np.zeros((2, 2))
        if not self.steps:
            return np.zeros(0), pairs, np.zeros(0)
        e = np.stack([np.zeros(n), emission], 1)
        fwd[self.steps[0]] = e[self.steps[0]]
        for before, now in zip(self.steps, self.steps[1:]):
            f = fwd[before[:len(now)]]
            for s in (0, 1):
                fwd[now, s] = e[now, s] + _log_add(f[:, 0] + trans[0, s], f[:, 1] + trans[1, s])
        for before, now in zip(self.steps[-2::-1], self.steps[:0:-1]):
            b = bwd[now] + e[now]
            rows = before[:len(now)]
            for s in (0, 1):
                bwd[rows, s] = _log_add(b[:, 0] + trans[s, 0], b[:, 1] + trans[s, 1])
        both = fwd + bwd
        z = _log_add(both[:, 0], both[:, 1])
        for before, now in zip(self.steps, self.steps[1:]):
            rows = before[:len(now)]
            for s in (0, 1):
                for r in (0, 1):
                    pairs[s, r] += np.exp(fwd[rows, s] + trans[s, r] + e[now, r] + bwd[now, r] - z[now]).sum()
        return np.exp(both[:, 1] - z), pairs, z[self.steps[0]]


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float
    constant: float | None = None  # score of every document where nothing can be learnt

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x, size, begin = line_features(texts)
        good, _, _ = Chains(begin).marginals(x @ self.weights, self.trans)
        return _sigmoid(self.slope * _logit(_document_mean(good, size, begin)) + self.shift)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _document_mean(good: np.ndarray, size: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals (an empty line weighs as one character)."""
    weight = np.maximum(size, 1)
    return np.add.reduceat(good * weight, begin[:-1]) / np.add.reduceat(weight, begin[:-1])


def _adam(gradient, p: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    m = v = np.zeros_like(p)
    for t in range(1, rounds + 1):
        g = gradient(p)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        p = p - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return p


def fit(x: np.ndarray, size: np.ndarray, begin: np.ndarray, label: np.ndarray) -> Model:
    """Fit the field and the calibration on documents with 0/1 labels."""
    if len(label) == 0 or label.min() == label.max():
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), 1.0, 0.0, float(label.mean()) if len(label) else 0.5)
    chains = Chains(begin)
    doc = np.repeat(np.arange(len(label)), np.diff(begin))
    y = label[doc].astype(np.float64)
    first = np.zeros(len(doc), bool)
    first[begin[:-1]] = True
    inner = np.flatnonzero(~first)
    # both kinds of documents weigh the same
    lines = len(doc)
    p = np.zeros(N_FEATURES + 4)
    for again in range(RELABELS):
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
        target = np.concatenate([x.T @ y, seen.ravel()])

        def gradient(p):
            good, pairs, _ = chains.marginals(x @ p[:N_FEATURES], p[N_FEATURES:].reshape(2, 2))
            return (np.concatenate([x.T @ good, pairs.ravel()]) - target) / lines + RIDGE * p

        p = _adam(gradient, p, ROUNDS, 0.1)
        good, _, _ = chains.marginals(x @ p[:N_FEATURES], p[N_FEATURES:].reshape(2, 2))
        y = np.where(label[doc] == 1, 1.0, (good > 0.5).astype(np.float64))
        worst = np.minimum.reduceat(good, begin[:-1])
        y[(label[doc] == 0) & (good == worst[doc])] = 0
    mean = _logit(_document_mean(good, size, begin))
    a = np.stack([mean, np.ones_like(mean)], 1)
    q = _adam(lambda q: a.T @ (_sigmoid(a @ q) - label) / len(label) + 1e-4 * q, np.array([1.0, 0.0]), 400, 0.1)
    return Model(p[:N_FEATURES], p[N_FEATURES:].reshape(2, 2), float(max(q[0], 0.0)), float(q[1]))


def held_out(modulus: int, remainder: int):
    """Rows whose crc32 of the id as text leaves the remainder; a null id never does."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return F.col("doc_id").isNotNull() & (crc % modulus == remainder)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, learn, sample: int) -> DataFrame:
    """At most ``sample`` labelled documents that may be learnt from, by hash of
    the id, with their whole texts: ``text, label``."""
    chosen = (labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & learn)
              .groupBy("doc_id").agg(F.min("label").alias("label"))
              .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # of rows that share an id one is learnt from, so the sample is bounded in rows
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Features of the sampled documents' lines come to the driver, not texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            x, size, begin = line_features(texts.to_pylist())
            parts = [x[a:b].astype("<f4").tobytes() for a, b in zip(begin[:-1], begin[1:])]
            sizes = [size[a:b].astype("<i8").tobytes() for a, b in zip(begin[:-1], begin[1:])]
            yield pa.RecordBatch.from_arrays([column(batch, "label").cast(pa.int32()), pa.array(parts, pa.binary()),
                                              pa.array(sizes, pa.binary())], ["label", "x", "size"])

    rows = training_sample(docs, labels, "quality", ~held_out(FOLDS, 0), sample) \
        .mapInArrow(run, "label int, x binary, size binary").collect()
    rows.sort(key=lambda r: (r.label, bytes(r.x)))
    xs = [np.frombuffer(r.x, "<f4").reshape(-1, N_FEATURES) for r in rows]
    begin = np.concatenate(([0], np.cumsum([len(v) for v in xs]))).astype(np.int64)
    if not rows:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0, np.int64), begin, np.zeros(0))
    return fit(np.concatenate(xs).astype(np.float64), np.concatenate([np.frombuffer(r.size, "<i8") for r in rows]),
               begin, np.array([r.label for r in rows]))


def quality_scores(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), score: str = "score") -> DataFrame:
    """Score of every row's whole text, next to the columns in ``keep``."""
    out = docs.select(*keep, F.col("text").alias("_sw_text"))
    schema = out.drop("_sw_text").schema.add(score, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "_sw_text"):
            s = model.scores(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in keep), pa.array(s, pa.float64())], [*keep, score])

    return out.mapInArrow(run, schema)


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(FOLDS, 0).alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op4_line_crf": op4_line_crf}
