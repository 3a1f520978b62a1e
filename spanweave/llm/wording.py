"""Vectorised words and word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

_MIX1, _MIX2, _GOLDEN = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_word_chars: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTES = [mix(np.arange(256, dtype=np.uint64) + np.uint64(k)) | np.uint64(1) for k in (1 << 20, 1 << 40)]


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def is_word_char(cps: np.ndarray) -> np.ndarray:
    if not _word_chars:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if chr(i).isalnum()]] = True
        _word_chars.append(table)
    return _word_chars[0][cps]


KEPT_POWERS = 1 << 20  # numbers of a kept table; a longer slice makes its own


def _grown(which: int, n: int) -> np.ndarray:
    p = _powers[which]
    if len(p) < n:
        step = np.full(max(n, min(2 * n, KEPT_POWERS)), (_BASE, _INVERSE)[which], np.uint64)
        step[0] = 1
        p = np.cumprod(step)
        if len(p) <= KEPT_POWERS:
            _powers[which] = p
    return p[:n]


def poly_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the byte strings ``data[b[i]:b[i + 1]]``."""
    low, high = int(bounds[0]), int(bounds[-1])
    data, at = data[low:high], bounds - low
    up, down = _grown(0, len(data)), _grown(1, len(data) + 1)[at[:-1]]
    out = []
    for table in _BYTES:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up, out=sums[1:])
        out.append(mix((sums[at[1:]] - sums[at[:-1]]) * down))
    return out[0], out[1]


def _segments(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Polynomial prefix sums over the code points, word starts and ends, and
    where each text begins."""
    low = [t.lower() for t in texts]
    cps = code_points("\n".join(low) + "\n") if low else np.zeros(0, np.uint32)
    inside = is_word_char(cps)
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * _grown(0, len(cps)), out=sums[1:])
    return sums, starts, ends, np.concatenate(([0], np.cumsum([len(t) + 1 for t in low]))).astype(np.int64)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased alphanumeric words of all texts in a row, and
    where each text's words begin (one more entry at the end)."""
    sums, starts, ends, text_starts = _segments(texts)
    hashes = mix((sums[ends] - sums[starts]) * _grown(1, len(sums))[starts])
    return hashes, np.searchsorted(starts, text_starts)


def heads(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``n`` characters of every longer word, and the text of each."""
    sums, starts, ends, text_starts = _segments(texts)
    starts = starts[ends - starts > n]
    return mix((sums[starts + n] - sums[starts]) * _grown(1, len(sums))[starts]), np.searchsorted(text_starts, starts, "right") - 1


def shingles(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of every text, and where each text's begin.
    A text with fewer words has one shingle of all its words; one without words
    has none."""
    w, begin = words(texts)
    counts = np.diff(begin)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(offsets[-1]) + np.repeat(begin[:-1] - offsets[:-1], n)
    last = np.repeat(begin[1:], n)
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        there = at + j < last
        out = mix(out * np.uint64(31) + np.where(there, w[np.minimum(at + j, max(len(w) - 1, 0))], np.uint64(0))) if len(w) else out
    return out, offsets


def weighted_cells(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle multisets as sorted unit cells (shingle, copy number), so that
    sizes of intersections and unions of cells are sums of minima and maxima of
    the multiplicities."""
    s, offsets = shingles(texts, size)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    order = np.lexsort((s, text))
    s, text = s[order], text[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (text[1:] != text[:-1]))) if len(s) else np.zeros(0, bool)
    at = np.arange(len(s))
    copy = at - np.maximum.accumulate(np.where(new, at, 0)) if len(s) else at
    return mix(s + copy.astype(np.uint64) * _GOLDEN), offsets
