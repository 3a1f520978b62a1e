"""Token counts by a prefix-sharing unigram dynamic program (operator 10).

A text is cut at white space into pre-tokens; each pre-token, marked with a
leading word mark, is segmented by the best path of a unigram model over the
pieces of a public vocabulary.  The distinct pre-tokens of a slice of texts
form a trie: the forward score of a prefix is computed once, however many
pre-tokens share it, and every pre-token's terminal keeps its token count.
The trie is walked depth first over the sorted pre-tokens, so only the current
root-to-leaf path is held.  Terminal counts stay in the worker between slices
and tasks, up to ``CACHE`` entries; beyond that they are computed again (the
result never depends on the cache).

Model: piece scores are ``-log(rank + 2.7)`` of the piece's place in the
vocabulary, in integer micro-nats, so that sums are exact; ties go to fewer
tokens.  A character outside the vocabulary costs its UTF-8 bytes, one byte
piece each, below every ordinary piece.

Defined results: null, empty and white texts have 0 tokens; one row per input
row, repeated rows and null ids included; other columns are ignored.  The
operator is narrow: no shuffle, nothing that grows with the corpus is held.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from spanweave.llm.common import column, table, text_slices

MARK = "▁"
CACHE = 300_000
SCHEMA = "doc_id long, n_words long, n_tokens long"


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> tuple[dict[str, int], int]:
    """Scores by piece, and the score of one byte piece."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    scores, rank = {}, 0
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        scores[sp.id_to_piece(i)] = -round(1e6 * math.log(rank + 2.7))
        rank += 1
    return scores, min(scores.values()) - 1_000_000


class TrieCounter:
    """Token counts of pre-tokens, forward scores shared along prefixes."""

    def __init__(self, scores: dict[str, int], byte_score: int, cache: int = CACHE):
        self.scores, self.byte_score, self.cache = scores, byte_score, cache
        self.longest = max(map(len, scores))
        self.terminals: dict[str, int] = {}
        self.prefixes = 0  # forward scores computed so far

    def _insert(self, words: list[str]) -> None:
        """Walk the trie of the sorted, distinct ``words``."""
        scores, longest, byte_score = self.scores, self.longest, self.byte_score
        best, count, before = [0], [0], ""
        for word in words:
            x = MARK + word
            keep, n = 0, min(len(x), len(before))
            while keep < n and x[keep] == before[keep]:
                keep += 1
            del best[keep + 1:], count[keep + 1:]
            for i in range(keep + 1, len(x) + 1):
                top, least = None, 0
                for j in range(max(0, i - longest), i):
                    s = scores.get(x[j:i])
                    if s is not None:
                        s += best[j]
                        c = count[j] + 1
                        if top is None or s > top or s == top and c < least:
                            top, least = s, c
                if x[i - 1] not in scores:
                    k = len(x[i - 1].encode("utf-8", "surrogatepass"))
                    s, c = best[i - 1] + k * byte_score, count[i - 1] + k
                    if top is None or s > top or s == top and c < least:
                        top, least = s, c
                best.append(top)
                count.append(least)
            self.prefixes += len(x) - keep
            self.terminals[word] = count[-1]
            before = x

    def counts(self, words: list[str]) -> np.ndarray:
        """Token counts of distinct pre-tokens."""
        if len(self.terminals) + len(words) > self.cache:
            self.terminals.clear()
        new = sorted(w for w in words if w and w not in self.terminals)
        self._insert(new)
        get = self.terminals.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))


_COUNTERS: dict[str, TrieCounter] = {}


def _counter(path: str) -> TrieCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TrieCounter(*read_pieces(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id``, number of pre-tokens and of tokens of every whole text."""
    path = model or default_model()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch, texts in text_slices(batches):
            lists = pc.utf8_split_whitespace(texts)
            ends = np.asarray(lists.offsets)
            words = lists.flatten()
            coded = words.dictionary_encode()
            codes = np.asarray(coded.indices)
            distinct = coded.dictionary.to_pylist()
            per_word = counter.counts(distinct)
            real = np.fromiter((w != "" for w in distinct), np.int64, len(distinct))
            sums = [np.concatenate(([0], np.cumsum(v[codes]))) if len(codes) else np.zeros(1, np.int64)
                    for v in (real, per_word)]
            ends = ends - ends[0]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").cast(pa.int64()), *(pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums)],
                ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, SCHEMA)


def op10_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op10_trie_counts": op10_trie_counts}
