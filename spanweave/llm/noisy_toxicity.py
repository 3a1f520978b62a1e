"""Toxicity of restored text: a noisy channel undone by Viterbi decoding (operator 9).

1. A character trigram model is counted over all texts (partial counts per
   task, summed in a shuffle over at most ``N_CLASSES ** 3`` codes).
2. A text is cut at white space.  In a chunk, runs of letters and leetspeak
   symbols, joined by separators or not, become character lattices wherever a
   symbol stands next to a letter (or symbols stand for a whole word), a
   separator joins letters, or a letter is doubled; so do runs of three or more
   one-letter chunks.  A symbol may stand for letters, a separator or a repeated
   letter may vanish (a separator between longer parts rather divides them).
   The best path under the character model and the channel's costs replaces the
   run; other runs have one path.  Runs with few paths are scored together, all
   paths of all of them at once; the others one by one, by Viterbi.  What a
   chunk gives as evidence is kept by the worker, within ``CACHE_BYTES``.
3. Restored texts are scored by words and word beginnings that are
   significantly more frequent in toxic documents (exact binomial tail with a
   Bonferroni bound), combined by a logistic fit.

Learning uses at most ``SAMPLE`` labelled documents that may be learnt from,
those with the smallest hash of their id.  Only text enters a score.

Defined results: null, empty and white texts have no evidence and get the
score of no evidence; repeated rows and null ids are kept, one row each; a null
id is never held out; of several labels of one id the smallest counts; without
labels of both kinds every score is the share of toxic labels (0 without
labels); other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import wording
from spanweave.llm.common import binary_parts, column, stored, table, text_slices
from spanweave.llm.encoding import LONGEST, ChunkIndex, Ragged
from spanweave.llm.line_crf import held_out, training_sample

SAMPLE = 16_000
FOLDS, REMAINDER, THRESHOLD = 3, 1, 0.7
PREFIXES = (4, 5, 6)   # lengths of word beginnings used as evidence
MIN_TOXIC = 3
SPAN_CACHE = 50_000

# Character classes: 0 boundary, then letters, then any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
N_CLASSES = len(LETTERS) + 2
# What a symbol may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "+": "t", "€": "e", "£": "l"}
SEPARATORS = " .-_*"
# Costs of the channel, in nats.
COST_SYMBOL, COST_SYMBOL_LOST, COST_REPEAT, COST_BREAK, COST_JOIN = 1.0, 9.0, 0.4, 4.0, 2.0

RUN = 3          # one-letter chunks in a row that count as one spaced-out word
PATHS = 128      # of a lattice that is scored path by path
CACHE_BYTES = 96 << 20  # of a worker's chunks

_L, _S = r"[^\W\d_]", "[" + re.escape("".join(LEET)) + "]"
_ANY = f"(?:{_L}|{_S})"
_RUN = re.compile(rf"{_ANY}+(?:[.\-_*]{{1,2}}{_ANY}+)*")
# what may make a run a lattice: a doubled letter, a symbol, a separator between letters or symbols
_SUSPECT = re.compile(rf"({_L})\1|{_S}|{_ANY}[.\-_*]{{1,2}}{_ANY}")
_DISGUISED = re.compile(rf"({_L})\1|{_L}{_S}|{_S}{_L}|{_ANY}[.\-_*]{{1,2}}{_ANY}|[@$€£!+]{{2}}")


_tables: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _tables:
        t = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = LETTERS.index(low) + 1 if len(low) == 1 and low in LETTERS else N_CLASSES - 1
        _tables.append(t)
    return _tables[0]


def trigram_counts(texts: list[str]) -> np.ndarray:
    c = _class_table()[wording.code_points("\n\n".join(["", *texts, ""]))].astype(np.int32)
    return np.bincount((c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:], minlength=N_CLASSES ** 3)


def character_model(docs: DataFrame) -> np.ndarray:
    """Interpolated log probabilities ``[before2, before1, char]`` over all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_CLASSES ** 3, np.int64)
        for _, texts in text_slices(batches):
            total += trigram_counts(texts.to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    rows = docs.select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(N_CLASSES ** 3)
    n[[r.code for r in rows]] = [r.n for r in rows]
    return smoothed(n.reshape((N_CLASSES,) * 3))


def smoothed(n: np.ndarray) -> np.ndarray:
    n = n.copy()
    n[0, 0, 0] = 0
    one = n.sum((0, 1)) + 0.5
    one /= one.sum()
    two = n.sum(0)
    two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
    three = (n + 5 * two[None]) / (n.sum(2, keepdims=True) + 5)
    return np.log(three).astype(np.float32)


def _options(span: str, i: int) -> list[tuple[str, float]]:
    """What the character at ``i`` may have been ('' is nothing), with costs."""
    c = span[i]
    if c in LEET:
        out = [(x, COST_SYMBOL) for x in LEET[c]] + [("", COST_SYMBOL_LOST)]
        if i and span[i - 1] == c:
            out.append(("", COST_REPEAT))
        return out
    if c in SEPARATORS:
        long = lambda part: len(part) > 1 and part.isalpha()
        if long(span[max(i - 2, 0):i]) and long(span[i + 1:i + 3]):
            return [("", COST_JOIN), (" ", 0.0)]
        return [("", 0.0), (" ", COST_BREAK)]
    return [(c, 0.0), ("", COST_REPEAT)] if i and span[i - 1] == c else [(c, 0.0)]


def decode(span: str, model: np.ndarray) -> str:
    """Best path of the span's lattice: exact Viterbi over the last two characters."""
    table_ = _class_table()
    states: dict = {(0, 0): (0.0, None)}
    for i in range(len(span)):
        new: dict = {}
        options = [(c, price, 0 if c in ("", " ") else int(table_[ord(c)])) for c, price in _options(span, i)]
        for (a, b), (cost, path) in states.items():
            for c, price, k in options:
                if c:
                    key, value = (b, k), cost + price - float(model[a, b, k])
                else:
                    key, value = (a, b), cost + price
                if key not in new or value < new[key][0]:
                    new[key] = (value, (path, c) if c else path)
        states = new
    _, path = min(((cost - float(model[a, b, 0]), path) for (a, b), (cost, path) in states.items()), key=lambda x: x[0])
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def _paths(span: str) -> list[tuple[str, float]] | None:
    """All paths of a lattice as (text, cost); none where there are too many."""
    out, plain = [("", 0.0)], 0
    for i in range(len(span)):
        options = _options(span, i)
        if len(options) > 1:
            head = span[plain:i]
            if len(out) * len(options) > PATHS:
                return None
            out = [(s + head + c, p + price) for s, p in out for c, price in options]
            plain = i + 1
    return [(s + span[plain:], p) for s, p in out]


def decode_all(spans: list[str], model: np.ndarray) -> list[str]:
    """``decode`` of many spans: the paths of all small lattices are scored at once."""
    found = [_paths(x) for x in spans]
    small = [i for i, f in enumerate(found) if f is not None]
    out = [decode(x, model) if f is None else "" for x, f in zip(spans, found)]
    paths = [p for i in small for p in found[i]]
    if paths:
        lens = np.fromiter((len(t) for t, _ in paths), np.int64, len(paths))
        c = _class_table()[wording.code_points("\n\n" + "\n\n".join(t for t, _ in paths) + "\n\n")].astype(np.int64)
        n = lens + 1  # trigrams of a path: from the boundary before it to the one behind
        first = np.cumsum(lens + 2) - lens - 2
        at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
        cost = -np.add.reduceat(model[c[at], c[at + 1], c[at + 2]].astype(np.float64), np.cumsum(n) - n)
        cost += np.fromiter((p for _, p in paths), np.float64, len(paths))
        begin = 0
        for i in small:
            end = begin + len(found[i])
            out[i] = paths[begin + int(np.argmin(cost[begin:end]))][0]
            begin = end
    return out


def _spans(chunk: str) -> list[tuple[int, int]]:
    """Where a lower-cased chunk's lattices begin and end."""
    out = []
    for m in _RUN.finditer(chunk):
        run = m.group().rstrip("!") if m.group()[:2].isalpha() else m.group()  # exclamation marks behind a word
        if _DISGUISED.search(run):
            out.append((m.start(), m.start() + len(run)))
    return out


class Restorer:
    """Restored chunks and their evidence (``only``: of these sorted hashes).
    What a distinct chunk gives is kept, within ``max_bytes``."""

    def __init__(self, model: np.ndarray, only: np.ndarray | None = None, max_bytes: int = CACHE_BYTES):
        self.model, self.only, self.max_bytes = model, only, max_bytes
        self._reset()

    def _reset(self) -> None:
        self.index, self.hits, self.letter = ChunkIndex(), Ragged(np.uint64), np.zeros(0, np.uint32)
        self.runs: dict[str, np.ndarray] = {}

    def restored(self, chunks: list[str]) -> list[str]:
        """The chunks in lower case, their lattices decoded."""
        low = [c.lower() for c in chunks]
        where = {i: sp for i, c in enumerate(low) if _SUSPECT.search(c) and (sp := _spans(c))}
        spans = list(dict.fromkeys(low[i][s:e] for i, sp in where.items() for s, e in sp))
        best = dict(zip(spans, decode_all(spans, self.model)))
        for i, sp in where.items():
            text, parts, at = low[i], [], 0
            for s, e in sp:
                parts += [text[at:s], best[text[s:e]]]
                at = e
            low[i] = "".join([*parts, text[at:]])
        return low

    def _evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Evidence of restored texts in a row, and how much each has."""
        h, at = chunk_evidence(texts)
        if self.only is not None:
            hit = np.zeros(len(h), bool)
            if len(self.only) and len(h):
                hit = self.only[np.minimum(np.searchsorted(self.only, h), len(self.only) - 1)] == h
            at = np.concatenate(([0], np.cumsum(hit)))[at]
            h = h[hit]
        return h, np.diff(at)

    def _entries(self, distinct: pa.Array) -> np.ndarray:
        data, bounds = binary_parts(distinct)
        first, second = wording.poly_hashes(data, bounds)
        if self.index.first.nbytes * 2.5 + self.hits.nbytes() + self.letter.nbytes > self.max_bytes:
            self._reset()
        at = self.index.find(first, second).astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            chunks = distinct.take(pa.array(missing)).to_pylist()
            at[missing] = self.hits.append(*self._evidence(self.restored(chunks)))
            letters = (ord(c) if len(c) == 1 and (c.isalpha() or c in LEET) else 0 for c in chunks)
            self.letter = np.concatenate([self.letter, np.fromiter(letters, np.uint32, len(chunks))])
            kept = missing[np.diff(bounds)[missing] <= LONGEST]
            self.index.add(first[kept], second[kept], at[kept].astype(np.int32))
        return at

    def _run(self, letters: np.ndarray) -> np.ndarray:
        """Evidence of a spaced-out word."""
        span = " ".join(map(chr, letters.tolist())).lower()
        if span not in self.runs:
            if len(self.runs) >= SPAN_CACHE:
                self.runs.clear()
            self.runs[span] = self._evidence(decode_all([span], self.model))[0]
        return self.runs[span]

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, hash) pairs of the restored texts."""
        lists = pc.utf8_split_whitespace(texts)
        ends = np.asarray(lists.offsets).astype(np.int64)
        ends -= ends[0]
        coded = lists.flatten().dictionary_encode()
        entry = self._entries(coded.dictionary)[np.asarray(coded.indices)]
        owner = np.repeat(np.arange(len(texts)), np.diff(ends))
        letter = self.letter[entry]
        flag = letter > 0
        edge = np.ones(len(entry) + 1, bool)  # where a run of one-letter chunks can't go on
        edge[1:-1] = (flag[1:] != flag[:-1]) | (owner[1:] != owner[:-1])
        bounds = np.flatnonzero(edge)
        run = np.flatnonzero((np.diff(bounds) >= RUN) & flag[bounds[:-1]]) if len(entry) else np.zeros(0, np.int64)
        got, n = self.hits.take(entry)
        if len(run):
            keep = np.ones(len(entry), bool)
            more = []
            for i, j in zip(bounds[run].tolist(), bounds[run + 1].tolist()):
                keep[i:j] = False
                more.append((int(owner[i]), self._run(letter[i:j])))
            got = np.concatenate([got[np.repeat(keep, n)], *(h for _, h in more)])
            owner = np.concatenate([np.repeat(owner[keep], n[keep]), *(np.full(len(h), o) for o, h in more)])
        else:
            owner = np.repeat(owner, n)
        order = np.lexsort((got, owner))
        owner, got = owner[order], got[order]
        keep = np.ones(len(got), bool)
        keep[1:] = (got[1:] != got[:-1]) | (owner[1:] != owner[:-1])
        return owner[keep], got[keep]


def chunk_evidence(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word beginnings of each chunk, and where each chunk's begin."""
    w, at = wording.words(chunks)
    owner, parts = [np.repeat(np.arange(len(chunks)), np.diff(at))], [w]
    for n in PREFIXES:
        heads, from_ = wording.heads(chunks, n)
        owner.append(from_)
        parts.append(wording.mix(heads + np.uint64(n)))
    owner, parts = np.concatenate(owner), np.concatenate(parts)
    order = np.argsort(owner, kind="stable")
    return parts[order], np.searchsorted(owner[order], np.arange(len(chunks) + 1))


@dataclass
class Scorer:
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    fitted: np.ndarray = field(default_factory=lambda: np.zeros(3))
    constant: float | None = 0.0

    def features(self, texts: pa.Array, restore: Restorer) -> np.ndarray:
        owner, h = restore.evidence(texts)
        x = np.zeros((len(texts), 3))
        x[:, 0] = 1
        if len(h):
            np.maximum.at(x[:, 1], owner, self.weights[np.searchsorted(self.hashes, h)])
            x[:, 2] = np.log1p(np.bincount(owner, minlength=len(texts)))
        return x

    def scores(self, texts: pa.Array, restore: Restorer) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.features(texts, restore) @ self.fitted, -30, 30)))


def _tail(k: int, n: int, p: float) -> float:
    """log P(at least k of n) for a binomial."""
    i = np.arange(k, n + 1)
    lf = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))
    terms = lf[n] - lf[i] - lf[n - i] + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(terms.max() + math.log(np.exp(terms - terms.max()).sum()))


def select(hashes: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> Scorer:
    """Evidence that is significantly toxic, weighted by its smoothed log odds."""
    p = n_toxic / (n_toxic + n_clean)
    often = toxic + clean >= MIN_TOXIC
    bound = -math.log(2 * max(int(often.sum()), 1))
    tried = np.flatnonzero((toxic >= MIN_TOXIC) & (toxic > 2 * p * (toxic + clean)))
    keep = np.array([i for i in tried.tolist() if _tail(int(toxic[i]), int(toxic[i] + clean[i]), p) < bound], np.int64)
    keep = keep[np.argsort(hashes[keep])] if len(keep) else keep
    odds = np.log((toxic[keep] + p) / (clean[keep] + 1 - p)) - math.log(p / (1 - p))
    return Scorer(hashes[keep], odds, np.zeros(3), None)


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, sample: int = SAMPLE) -> Scorer:
    """Counts of the sampled documents' evidence, then the logistic fit."""
    sampled = training_sample(docs, labels, "toxic", ~held_out(FOLDS, REMAINDER), sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model)
        for batch, texts in text_slices(batches):
            owner, h = restore.evidence(texts)
            label = np.asarray(column(batch, "label").cast(pa.int64()))
            u, back = np.unique(h, return_inverse=True)
            toxic = np.bincount(back, weights=label[owner], minlength=len(u)).astype(np.int64)
            clean = np.bincount(back, minlength=len(u)) - toxic
            # row of its own for the documents themselves: hash 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(([0], u.view(np.int64)))), pa.array(np.concatenate(([label.sum()], toxic))),
                 pa.array(np.concatenate(([len(label) - label.sum()], clean)))], ["hash", "toxic", "clean"])

    counts = sampled.mapInArrow(count, "hash long, toxic long, clean long").groupBy("hash") \
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = stored(counts, "toxicity-evidence")
    n = counts.where("hash = 0").collect()
    n_toxic, n_clean = (n[0].toxic, n[0].clean) if n else (0, 0)
    if not n_toxic or not n_clean:
        return Scorer(constant=n_toxic / max(n_toxic + n_clean, 1))
    often = int(counts.where(f"toxic + clean >= {MIN_TOXIC} and hash <> 0").count())
    rows = counts.where(f"toxic >= {MIN_TOXIC} and hash <> 0 and toxic > clean * {n_toxic / n_clean}").collect()
    a = np.array([(r.hash, r.toxic, r.clean) for r in rows], np.int64).reshape(-1, 3)
    scorer = select_with(a, n_toxic, n_clean, often)

    def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model, scorer.hashes)
        for batch, texts in text_slices(batches):
            x = scorer.features(texts, restore)
            yield pa.RecordBatch.from_arrays([column(batch, "label").cast(pa.int32()), pa.array(x[:, 1]), pa.array(x[:, 2])],
                                             ["label", "top", "hits"])

    got = sampled.mapInArrow(feature_rows, "label int, top double, hits double").collect()
    x = np.array([(1.0, r.top, r.hits) for r in got])
    scorer.fitted = logistic(x, np.array([r.label for r in got], float))
    return scorer


def select_with(a: np.ndarray, n_toxic: int, n_clean: int, often: int) -> Scorer:
    """``select`` over counts whose rarer or cleaner rows stayed on the cluster."""
    pad = max(0, often - len(a))
    s = select(a[:, 0].view(np.uint64) if len(a) else np.zeros(0, np.uint64),
               np.concatenate([a[:, 1], np.zeros(pad, np.int64)]), np.concatenate([a[:, 2], np.full(pad, MIN_TOXIC)]),
               n_toxic, n_clean)
    return s


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def toxicity_scores(docs: DataFrame, model: np.ndarray, scorer: Scorer) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model, scorer.hashes)
        for batch, texts in text_slices(batches):
            s = scorer.scores(texts, restore)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op9_noisy_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = character_model(docs)
    scored = toxicity_scores(docs, model, train(docs, table(spark, sf_dir, "labels"), model))
    return scored.select("doc_id", held_out(FOLDS, REMAINDER).alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op9_noisy_toxicity": op9_noisy_toxicity}
