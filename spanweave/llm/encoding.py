"""Batch encoding with public tokenizers, distinct chunks once per worker.

Both vocabularies cut a text into pre-tokens before any merge, and no
pre-token crosses a single space or newline that stands between two non-white
characters.  So a text is split there, the chunks of a slice are
dictionary-encoded in Arrow, and only chunks the worker hasn't seen go through
the ``tokenizers`` library.  A text with any other white space next to a
separator (runs, leading or trailing white space), or with one of the
vocabulary's added tokens in it, is encoded whole by the library.

What a worker keeps are numpy arrays, bounded in bytes (``max_bytes``): a
sorted table of 128-bit chunk hashes and the ids of the chunks; no Python
object per chunk.  Results never depend on what is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from spanweave.llm.common import binary_parts, ragged_take
from spanweave.llm.wording import mix, poly_hashes

CACHE_BYTES = 72 << 20  # of one encoder in one worker
LONGEST = 512           # bytes of a chunk that is kept


class ChunkIndex:
    """Entry numbers by 128-bit hash, in sorted arrays."""

    ENTRY_BYTES = 20

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.first, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.entry = np.zeros(0, np.int32)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        out = np.full(len(first), -1, np.int32)
        if len(self.first) and len(first):
            order = np.argsort(first)
            at = np.minimum(np.searchsorted(self.first, first[order]), len(self.first) - 1)
            ok = (self.first[at] == first[order]) & (self.second[at] == second[order])
            out[order[ok]] = self.entry[at[ok]]
        return out

    def add(self, first: np.ndarray, second: np.ndarray, entry: np.ndarray) -> None:
        """Hashes whose first half is new; others stay unknown (and are encoded again)."""
        first, at = np.unique(first, return_index=True)
        place = np.searchsorted(self.first, first)
        if len(self.first):
            new = self.first[np.minimum(place, len(self.first) - 1)] != first
            first, at, place = first[new], at[new], place[new]
        self.first = np.insert(self.first, place, first)
        self.second = np.insert(self.second, place, second[at])
        self.entry = np.insert(self.entry, place, entry[at])


class Ragged:
    """Growing rows of numbers."""

    def __init__(self, dtype):
        self.flat, self.ends, self.used, self.rows = np.zeros(1 << 12, dtype), np.zeros(1 << 12, np.int32), 0, 0

    def append(self, values: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Numbers of the new rows."""
        need, rows = self.used + len(values), self.rows + len(lens) + 1
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(need + (need >> 2) - self.used, self.flat.dtype)])
        if rows > len(self.ends):
            self.ends = np.concatenate([self.ends[:self.rows + 1], np.zeros(rows + (rows >> 2) - self.rows - 1, np.int32)])
        self.flat[self.used:need] = values
        self.ends[self.rows + 1:rows] = self.used + np.cumsum(lens)
        out = np.arange(self.rows, rows - 1)
        self.used, self.rows = need, rows - 1
        return out

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the rows in a row, and how many each has."""
        begin = self.ends[rows].astype(np.int64)
        lens = self.ends[rows + 1] - begin
        return ragged_take(self.flat, begin, lens), lens

    def nbytes(self) -> int:
        return self.flat.nbytes + self.ends.nbytes


class Chunks:
    """A slice's texts as chunk codes: ``codes`` of all texts in a row,
    ``starts`` of each text's codes, and for each distinct code its hash and
    (on demand) its string."""

    LEADS = (" ", "\n", "")

    def __init__(self, texts: pa.Array, spaced: bool, start: int = 2):
        """``start``: the lead of a text's first chunk."""
        if spaced:
            lines = pc.split_pattern(texts, "\n")
            line_ends = np.asarray(lines.offsets).astype(np.int64)
            words = pc.split_pattern(lines.flatten(), " ")
            word_ends = np.asarray(words.offsets).astype(np.int64)
            line_ends -= line_ends[0]
            word_ends -= word_ends[0]
            self.starts = word_ends[line_ends]
        else:
            words = pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")
            self.starts = np.asarray(words.offsets).astype(np.int64)
            self.starts -= self.starts[0]
        coded = words.flatten().dictionary_encode()
        self.dictionary = coded.dictionary
        codes = np.asarray(coded.indices)
        data, at = binary_parts(self.dictionary)
        sizes = np.diff(at)
        first, second = poly_hashes(data, at)
        d = len(sizes)
        if spaced:  # a chunk after a space, after a newline, or at the start of its text
            lead = np.zeros(len(codes), np.int64)
            lead[word_ends[:-1]] = 1
            lead[self.starts[:-1]] = start
            codes = codes + lead * d
            seen = np.zeros(3 * d, bool)
            seen[codes] = True
            kinds = np.flatnonzero(seen)
            new = np.zeros(3 * d, np.int64)
            new[kinds] = np.arange(len(kinds))
            codes = new[codes]
            self.lead, self.chunk = kinds // max(d, 1), kinds % max(d, 1)
            salt = self.lead.astype(np.uint64) << np.uint64(56)
            first, second = mix(first[self.chunk] ^ salt), mix(second[self.chunk] ^ salt)
        else:
            self.lead, self.chunk = np.full(d, 2), np.arange(d)
        self.codes, self.first, self.second = codes, first, second
        self.kept = sizes[self.chunk] <= LONGEST

    def strings(self, which: np.ndarray) -> list[str]:
        found = self.dictionary.take(pa.array(self.chunk[which])).to_pylist()
        return [self.LEADS[k] + s for k, s in zip(self.lead[which].tolist(), found)]


class ChunkEncoder:
    """``spaced``: white space is part of the ids (byte-level vocabularies);
    otherwise it only separates words, and ASCII letters are folded early
    (the vocabulary is lower case).  ``added``: the vocabulary's added tokens
    have their own ids in a text, as in the library's plain ``encode``;
    otherwise such strings are ordinary text."""

    def __init__(self, path: str, spaced: bool, max_bytes: int = CACHE_BYTES, added: bool = False):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.spaced, self.max_bytes = spaced, max_bytes
        self.size = self.tokenizer.get_vocab_size()
        points = {c: self._whole([c])[0] for c in ".,"}
        self.points = {c: ids[0] for c, ids in points.items() if len(ids) == 1}
        # pieces that begin (a space) or end (a word end) a word of many encoded together
        self.edge = np.zeros(self.size, bool)
        self.edge[[i for t, i in self.tokenizer.get_vocab().items() if (t.startswith("Ġ") if spaced else t.endswith("</w>"))]] = True
        self.looked, self.missed = 0, 0  # chunks of slices, and those that weren't kept
        self._reset()

    def _reset(self) -> None:
        self.index = ChunkIndex()
        self.ids = Ragged(np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.bad = np.zeros(0, bool)

    def _whole(self, keys: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(keys, add_special_tokens=False)]

    @staticmethod
    def _flat(got: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((x for g in got for x in g), np.uint32, int(lens.sum())), lens

    def _words(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of keys of one pre-token each, in one call; the pieces tell where a
        word begins or ends."""
        if not keys:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids = np.asarray(self._whole([("" if self.spaced else " ").join(keys)])[0], np.uint32)
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) == len(keys):
            if self.spaced and edges[0] == 0:
                return ids, np.diff(edges, append=len(ids))
            if not self.spaced and edges[-1] == len(ids) - 1:
                return ids, np.diff(edges, prepend=-1)
        return self._flat(self._whole(keys))

    def _is_word(self, key: str) -> bool:
        """Surely one pre-token: letters (of long-settled Unicode ranges) that stay
        one letter each in lower case, after a space where spaces count."""
        body = key[1:] if self.spaced and key[:1] == " " else key
        return (body.isalpha() and max(body) < "ɐ" and "İ" not in body
                and (len(body) < len(key) or not self.spaced))

    def learn(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the keys in a row, and how many each has.  Words with one comma
        or full stop are made of their two pre-tokens; other words go through the
        library together, anything else by itself."""
        stem = np.full(len(keys), -1)
        words: dict[str, int] = {}
        rest, point = [], np.zeros(len(keys), np.uint32)
        for i, k in enumerate(keys):
            tail = self.points.get(k[-1:])
            if tail is not None and self._is_word(k[:-1]):
                stem[i] = words.setdefault(k[:-1], len(words))
                point[i] = tail + 1
            elif self._is_word(k):
                stem[i] = words.setdefault(k, len(words))
            else:
                rest.append(i)
        rows = Ragged(np.uint32)
        rows.append(*self._words(list(words)))
        stem[rest] = rows.append(*self._flat(self._whole([keys[i] for i in rest])))
        ids, lens = rows.take(stem)
        if not point.any():
            return ids, lens
        pointed = point > 0
        return np.insert(ids, np.cumsum(lens)[pointed], point[pointed] - 1), lens + pointed

    def entries(self, chunks: Chunks) -> np.ndarray:
        """Entry of each distinct chunk of the slice."""
        if self.index.first.nbytes * 2.5 + self.ids.nbytes() > self.max_bytes:
            self._reset()
        at = self.index.find(chunks.first, chunks.second).astype(np.int64)
        missing = np.flatnonzero(at < 0)
        self.looked += len(at)
        self.missed += len(missing)
        if len(missing):
            keys = chunks.strings(missing)
            new = self.ids.append(*self.learn(keys))
            if self.spaced:
                self.bad = np.concatenate([self.bad, np.fromiter(map(_ragged_space, keys), bool, len(keys))])
            at[missing] = new
            kept = missing[chunks.kept[missing]]
            self.index.add(chunks.first[kept], chunks.second[kept], at[kept].astype(np.int32))
        return at

    def whole(self, texts: pa.Array, chunks: Chunks, at: np.ndarray) -> np.ndarray:
        """Texts that have to be encoded whole."""
        n = len(texts)
        out = np.zeros(n, bool)
        if self.spaced and len(chunks.codes):
            hit = np.concatenate(([0], np.cumsum(self.bad[at][chunks.codes])))
            out = hit[chunks.starts[1:]] > hit[chunks.starts[:-1]]
        if self.added:
            mark = min((t[:2] for t in self.added), key=len)
            some = np.flatnonzero(np.asarray(pc.match_substring(texts, mark)))
            for i in some.tolist() if all(t.startswith(mark) for t in self.added) else range(n):
                low = texts[i].as_py().lower()
                out[i] |= any(t.lower() in low for t in self.added)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each."""
        chunks = Chunks(texts, self.spaced)
        at = self.entries(chunks)
        whole = self.whole(texts, chunks, at)
        ids, lens = self.ids.take(at[chunks.codes])
        total = np.concatenate(([0], np.cumsum(lens)))
        counts = total[chunks.starts[1:]] - total[chunks.starts[:-1]]
        ids = ids.astype(np.uint32)
        if whole.any():
            some = np.flatnonzero(whole)
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, got in zip(some.tolist(), self._whole([texts[i].as_py() for i in some.tolist()])):
                parts[i] = np.asarray(got, np.uint32)
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            ids = np.concatenate(parts)
        return ids, counts


def _ragged_space(key: str) -> bool:
    """White space other than one leading separator, at an end of the chunk."""
    body = key[1:] if key[:1] in (" ", "\n") else key
    return not body or body[0].isspace() or body[-1].isspace()


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the id ``end`` to every document."""
    out = np.insert(ids, np.cumsum(counts), np.uint32(end))
    return out.astype(np.uint32, copy=False), counts + 1


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, spaced: bool, added: bool = True) -> ChunkEncoder:
    """The worker's encoder for a vocabulary; kept between tasks, and the only one kept."""
    if (path, spaced, added) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, spaced, added] = ChunkEncoder(path, spaced, added=added)
    return _ENCODERS[path, spaced, added]


def forget() -> None:
    """Drop what the worker keeps (at the start of stages that need its memory)."""
    _ENCODERS.clear()
