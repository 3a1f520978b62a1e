"""Cross-tokenizer alignment by products of sparse incidence matrices (operator 12).

A text (a space in front) is encoded by two public tokenizers, A and B.  Both
cover the same bytes, so each is a token-byte incidence matrix, hand-built in
compressed rows:

1. ``A . B^T`` by Gustavson's row products (for each row of A, the rows of B^T
   that its entries name are added up) gives the *overlap links*: token pairs
   with a byte in common, and how many bytes.  Those whose ranges end together
   are the *links*; where they end, the text is cut into *groups*.
2. The token-group incidence matrices' product gives the *shared-group links*:
   token pairs of one group.
3. How often an id pair is linked is counted over the whole corpus; a document's
   digest adds up the counts of its links and finds the links that are their B
   id's most frequent.

Neither tokenizer joins anything across a single space or newline between
non-white characters (checked on the vocabulary when a worker starts), so a
text's products are block diagonal there: blocks of equal chunks are multiplied
once and kept by the worker, within ``CACHE_BYTES``.  A text with other white
space, or whose chunks a tokenizer changes, is multiplied whole.

Of two tokens that end together one is the other's suffix, so distinct linked
id pairs are at most the summed lengths of both vocabularies' tokens (about
half a million), whatever the corpus: that bounds the counts that reach the
driver and every task.  Documents are read and encoded once; their links are
stored as id pairs.

Defined results: null and empty texts, and texts that a tokenizer doesn't give
back byte by byte (``joined bytes differ from space + text``), have no tokens:
zeros and an empty ``groups_sha256``.  Special tokens' strings are plain text.
Repeated rows and null ids are kept, one row each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spanweave.llm.common import column, ragged_take, stored, table, text_slices
from spanweave.llm.encoding import ChunkEncoder, ChunkIndex, Chunks, Ragged

CACHE_BYTES = 96 << 20  # of one worker's aligned chunks
SPACE_MARK = "▁"
LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, n_shared long, groups_sha256 string, links binary"


@dataclass
class Csr:
    """Rows of column numbers with values."""
    bounds: np.ndarray
    cols: np.ndarray
    vals: np.ndarray
    width: int

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        order = np.argsort(self.cols, kind="stable")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(self.cols, minlength=self.width))))
        return Csr(bounds, rows[order], self.vals[order], len(self.bounds) - 1)


def byte_incidence(ends: np.ndarray, size: int) -> Csr:
    """Tokens (by the ends of their adjacent byte ranges) against bytes."""
    return Csr(np.concatenate(([0], ends)), np.arange(size), np.ones(size, np.int64), size)


def group_incidence(group: np.ndarray, groups: int) -> Csr:
    """Tokens against the groups they lie in."""
    return Csr(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), groups)


def gustavson(a: Csr, b: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The product ``a . b`` as (row, column, value), rows and columns ascending:
    a row is the sum of the rows of ``b`` that its entries name."""
    lens = np.diff(b.bounds)[a.cols]
    begin = b.bounds[a.cols]
    rows = np.repeat(np.repeat(np.arange(len(a.bounds) - 1), np.diff(a.bounds)), lens)
    cols = ragged_take(b.cols, begin, lens)
    vals = np.repeat(a.vals, lens) * ragged_take(b.vals, begin, lens)
    key = rows * b.width + cols
    if len(key) and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, vals = key[order], vals[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] // max(b.width, 1), key[first] % max(b.width, 1), np.add.reduceat(vals, first) if len(first) else vals


@dataclass
class Blocks:
    """Aligned texts or chunks in a row: tokens of each side with the byte ends
    over all blocks, links and groups."""
    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    overlaps: tuple[np.ndarray, np.ndarray, np.ndarray]  # (A token, B token, bytes)
    links: tuple[np.ndarray, np.ndarray]                 # (A token, B token)
    a_group: np.ndarray
    b_group: np.ndarray
    shared: tuple[np.ndarray, np.ndarray]                # (A token, B token)


def multiply(a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> Blocks:
    """All products of token rows that cover the same bytes."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    size = int(a_end[-1]) if len(a) else 0
    over = gustavson(byte_incidence(a_end, size), byte_incidence(b_end, size).transposed())
    together = a_end[over[0]] == b_end[over[1]]
    links = over[0][together], over[1][together]
    cuts = a_end[links[0]]
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    shared = gustavson(group_incidence(a_group, len(cuts)), group_incidence(b_group, len(cuts)).transposed())
    return Blocks(a, b, a_end, b_end, over, links, a_group, b_group, shared[:2])


def _byte_table() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(x): x for x in plain}
    rest = [x for x in range(256) if chr(x) not in out]
    return out | {chr(256 + i): x for i, x in enumerate(rest)}


class Vocabulary:
    """Bytes of every id, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.begin = np.cumsum(self.lens) - self.lens

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        return ragged_take(self.flat, self.begin[ids], self.lens[ids])


def byte_level_vocabulary(tokenizer) -> Vocabulary:
    chars = _byte_table()
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        out[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
    return Vocabulary(out)


def piece_vocabulary(pieces) -> Vocabulary:
    out = []
    for i in range(pieces.get_piece_size()):
        p = pieces.id_to_piece(i)
        out.append(bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace(SPACE_MARK, " ").encode())
    return Vocabulary(out)


class Aligner:
    """Aligned chunks of a worker."""

    def __init__(self, path_a: str, path_b: str, max_bytes: int = CACHE_BYTES):
        import sentencepiece
        self.encoder = ChunkEncoder(path_a, True, max_bytes=0)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.va, self.vb = byte_level_vocabulary(self.encoder.tokenizer), piece_vocabulary(self.pieces)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        # no piece joins what stands on two sides of a space or newline
        self.splits = not any("\n" in p or SPACE_MARK in p.lstrip(SPACE_MARK) for p in names)
        self.mark = self.pieces.piece_to_id(SPACE_MARK)
        self.wide = len(self.vb.lens)
        digits = [b"%d," % i for i in range(max(len(self.va.lens), self.wide))]
        self.digits, self.digit_len = np.frombuffer(b"".join(digits), np.uint8), np.fromiter(map(len, digits), np.int64, len(digits))
        self.digit_at = np.cumsum(self.digit_len) - self.digit_len
        self.max_bytes = max_bytes
        self._reset()

    def _reset(self) -> None:
        self.index, self.names, self.links = ChunkIndex(), Ragged(np.uint8), Ragged(np.uint32)
        self.sizes, self.bad = np.zeros((0, 5), np.int32), np.zeros(0, bool)

    def _pieces_of(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of keys, each with its leading space (put there by the model) or newline."""
        got = self.pieces.encode([k[1:] if k[0] == " " else k for k in keys], num_threads=1)
        for i, k in enumerate(keys):
            if k[0] != " ":
                got[i] = got[i][1:] if got[i][:1] == [self.mark] else []
        return self.encoder._flat(got)

    def rows(self, keys: list[str], learn) -> tuple:
        """Ids and counts of both sides, and which keys both give back byte by byte;
        the others have no tokens."""
        a, na = learn(keys)
        b, nb = self._pieces_of(keys)
        raw = [k.encode("utf-8", "surrogatepass") for k in keys]
        want = np.frombuffer(b"".join(raw), np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        owner = np.repeat(np.arange(len(keys)), size)
        ok = np.ones(len(keys), bool)
        for v, ids, n in ((self.va, a, na), (self.vb, b, nb)):
            of = np.repeat(np.arange(len(keys)), n)
            covered = np.bincount(of, weights=v.lens[ids], minlength=len(keys)).astype(np.int64)
            fits = covered == size
            got = v.bytes(ids[fits[of]])
            same = fits.copy()
            there = fits[owner]
            same[owner[there][got != want[there]]] = False
            ok &= same
        a, b = a[ok[np.repeat(np.arange(len(keys)), na)]], b[ok[np.repeat(np.arange(len(keys)), nb)]]
        return a.astype(np.int64), np.where(ok, na, 0), b.astype(np.int64), np.where(ok, nb, 0), ok

    def digest(self, keys: list[str], learn) -> tuple:
        """Per key: group strings (bytes in a row, lengths), link id pairs (in a
        row, counts), sizes (A, B, groups, overlap links, shared-group links), ok."""
        a, na, b, nb, ok = self.rows(keys, learn)
        m = multiply(a, b, self.va.lens[a], self.vb.lens[b])
        ka, kb = np.repeat(np.arange(len(keys)), na), np.repeat(np.arange(len(keys)), nb)
        count = lambda owner: np.bincount(owner, minlength=len(keys))
        pairs = (a[m.links[0]] * self.wide + b[m.links[1]]).astype(np.uint32 if len(self.va.lens) * self.wide < 1 << 32 else np.uint64)
        n_links = count(ka[m.links[0]])
        sizes = np.stack([na, nb, n_links, count(ka[m.overlaps[0]]), count(ka[m.shared[0]])], 1)
        # the groups written out: A ids, then B ids of each group
        side = np.concatenate([m.a_group * 2, m.b_group * 2 + 1])
        order = np.argsort(side, kind="stable")
        ids, side, key = np.concatenate([a, b])[order], side[order], np.concatenate([ka, kb])[order]
        lens = self.digit_len[ids]
        text = ragged_take(self.digits, self.digit_at[ids], lens).copy()
        last = np.cumsum(lens) - 1
        after = np.append(side[1:], -1)
        text[last] = np.where(after == side, ord(","), np.where(after == side + 1, np.where(side % 2 == 0, ord("|"), ord(";")), ord(";")))
        size = np.bincount(key, weights=lens, minlength=len(keys)).astype(np.int64)
        ends = np.cumsum(size)
        text = np.delete(text, ends[size > 0] - 1)  # no separator behind a key's last group
        return text, np.maximum(size - 1, 0), pairs, n_links, sizes, ok

    def entries(self, chunks: Chunks) -> np.ndarray:
        held = self.index.first.nbytes * 2.5 + self.names.nbytes() + self.links.nbytes() + self.sizes.nbytes
        if held > self.max_bytes:
            self._reset()
        at = self.index.find(chunks.first, chunks.second).astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            keys = chunks.strings(missing)
            text, size, pairs, n_links, sizes, ok = self.digest(keys, self.encoder.learn)
            at[missing] = self.names.append(text, size)
            self.links.append(pairs, n_links)
            self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
            white = np.fromiter((not k[1:] or k[1].isspace() or k[-1].isspace() for k in keys), bool, len(keys))
            self.bad = np.concatenate([self.bad, white | ~ok])
            kept = missing[chunks.kept[missing]]
            self.index.add(chunks.first[kept], chunks.second[kept], at[kept].astype(np.int32))
        return at

    def _whole_rows(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder._flat(self.encoder._whole(keys))

    def texts(self, texts: pa.Array) -> list[tuple]:
        """Per text: sizes, link id pairs, groups' sha256 ('' without tokens)."""
        n = len(texts)
        empty = np.asarray(pc.binary_length(texts)) == 0
        chunks = Chunks(texts, True, start=0)
        at = self.entries(chunks)
        entry = at[chunks.codes]
        hit = np.concatenate(([0], np.cumsum(self.bad[entry])))
        whole = (hit[chunks.starts[1:]] > hit[chunks.starts[:-1]]) | (not self.splits)
        begin = chunks.starts[:-1]
        sizes = np.add.reduceat(self.sizes[entry].astype(np.int64), begin, axis=0) if n else np.zeros((0, 5), np.int64)
        pairs, n_pairs = self.links.take(entry)
        pair_at = np.concatenate(([0], np.cumsum(n_pairs)))[chunks.starts]
        name, name_len = self.names.take(at)
        names = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [
            None, pa.py_buffer(np.concatenate(([0], np.cumsum(name_len)))), pa.py_buffer(np.ascontiguousarray(name))])
        lists = pa.LargeListArray.from_arrays(pa.array(chunks.starts), names.take(pa.array(chunks.codes)))
        joined = pc.binary_join(lists, pa.scalar(b";", pa.large_binary()))
        out = []
        for i in range(n):
            if empty[i]:
                out.append((np.zeros(5, np.int64), pairs[:0], ""))
            elif whole[i]:
                text, _, p, _, s, _ = self.digest([" " + texts[i].as_py()], self._whole_rows)
                out.append((s[0], p, hashlib.sha256(text.tobytes()).hexdigest() if s[0][0] else ""))
            else:
                out.append((sizes[i], pairs[pair_at[i]:pair_at[i + 1]], hashlib.sha256(joined[i].as_buffer()).hexdigest()))
        return out


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner; kept between tasks."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def linked_documents(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per document with the columns of ``LINKED``, written once;
    ``links`` holds id pairs (A id times the size of B's vocabulary plus B id) as
    little-endian unsigned 32-bit integers."""
    paths = paths or default_tokenizers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(*paths)
        for batch, texts in text_slices(batches):
            rows = al.texts(texts)
            sizes = np.stack([r[0] for r in rows]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").cast(pa.int64()), *(pa.array(sizes[:, k]) for k in (0, 1, 2, 2, 3, 4)),
                 pa.array([r[2] for r in rows]), pa.array([r[1].astype("<u4").tobytes() for r in rows], pa.binary())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared", "groups_sha256", "links"])

    return stored(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, LINKED), "token-links")


def _pairs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Link id pairs of all rows, and how many each row has."""
    raw = column(batch, "links").to_pylist()
    return np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4


def pair_counts(linked: DataFrame) -> DataFrame:
    """``pair, n``: how many links of the corpus hold each id pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = np.unique(_pairs_of(batch)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])

    return linked.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def scored(linked: DataFrame, n_b: int) -> DataFrame:
    """Documents with ``n_best`` and ``count_sum``; ``n_b``: ids of B."""
    got = pair_counts(linked).toArrow()  # bounded by the vocabularies, see above
    pair, n = np.asarray(got["pair"]).astype(np.int64), np.asarray(got["n"]).astype(np.int64)
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    highest = np.zeros(n_b, np.int64)
    np.maximum.at(highest, pair % n_b, n)
    best = n == highest[pair % n_b]
    pair = pair.astype(np.uint32)
    kept = [c for c in linked.columns if c != "links"]
    schema = StructType([*linked.select(*kept).schema.fields, StructField("n_best", LongType()), StructField("count_sum", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, size = _pairs_of(batch)
            at = np.searchsorted(pair, flat)
            ends = np.cumsum(size)
            total = lambda x: np.concatenate(([0], np.cumsum(x)))
            sums = [t[ends] - t[ends - size] for t in (total(best[at].astype(np.int64)), total(n[at]))] if len(flat) else [size, size]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept), *map(pa.array, sums)], [*kept, "n_best", "count_sum"])

    return linked.mapInArrow(run, schema)


ALIGNED = ("doc_id long, a_ids array<long>, b_ids array<long>, a_ends array<long>, b_ends array<long>, cuts array<long>, "
           "overlaps array<struct<a: long, b: long, bytes: long>>, links array<struct<a: long, b: long>>, shared array<struct<a: long, b: long>>")


def alignments(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """The whole alignment of every document: ids and byte ends of both sides,
    where groups end, and overlap, end and shared-group links as token numbers."""
    paths = paths or default_tokenizers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(*paths)
        schema = None
        for batch, texts in text_slices(batches):
            rows = []
            for d, t in zip(column(batch, "doc_id").to_pylist(), texts.to_pylist()):
                a, _, b, _, _ = al.rows([" " + t] if t else [], al._whole_rows) if t else (np.zeros(0, np.int64),) * 5
                m = multiply(a, b, al.va.lens[a], al.vb.lens[b])
                pairs = lambda x: [dict(zip(("a", "b", "bytes"), p)) for p in zip(*(v.tolist() for v in x))]
                rows.append({"doc_id": d, "a_ids": a.tolist(), "b_ids": b.tolist(), "a_ends": m.a_end.tolist(), "b_ends": m.b_end.tolist(),
                             "cuts": m.a_end[m.links[0]].tolist(), "overlaps": pairs(m.overlaps), "links": pairs(m.links), "shared": pairs(m.shared)})
            if schema is None:
                two = pa.struct([("a", pa.int64()), ("b", pa.int64())])
                many = pa.list_(pa.int64())
                schema = pa.schema([("doc_id", pa.int64()), *((c, many) for c in ("a_ids", "b_ids", "a_ends", "b_ends", "cuts")),
                                    ("overlaps", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("bytes", pa.int64())]))),
                                    ("links", pa.list_(two)), ("shared", pa.list_(two))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ALIGNED)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = default_tokenizers()
    import sentencepiece
    n_b = sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    out = scored(linked_documents(table(spark, sf_dir, "documents"), paths), n_b)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_shared")


QUERIES = {"op12_token_alignment": op12_token_alignment}
