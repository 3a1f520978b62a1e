"""Token ids in a grammar-compressed binary format (operator 1).

Documents are encoded in ascending ``doc_id`` order, an end id follows each
document, and runs of whole documents become *shards*.  Inside a shard Re-Pair
replaces frequent adjacent id pairs by nonterminals, round after round, until
no pair is frequent; a round replaces every chosen pair at once (pairs whose
occurrences can't overlap each other).  A shard keeps the rules, the expansion
length of each rule, the remaining symbols and the documents' lengths, so any
range of ids is decoded by expanding only the symbols that cover it.

File format: a Parquet table of shards (committed by Spark, so a lost executor
leaves no half-written file) with the columns of ``SHARD``; binary columns hold
little-endian unsigned 32-bit integers.  Rule ``i`` has symbol ``base + i`` and
refers only to smaller symbols.

Defined results: a null or empty text is a document with only its end id;
documents with a null id come first; rows with equal ids stay separate
documents, ordered by their texts' md5; an empty table gives an empty file.  Other
columns are ignored.  The range shuffle moves each text once; starts come from
a prefix sum over partition totals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.llm.common import column, ragged_take, stored, table, text_slices
from spanweave.llm.encoding import encoder, with_end

END_ID = 1
SHARD_IDS = 1 << 19   # a shard closes at the first document end past this many ids
MIN_COUNT = 8         # a pair is frequent from this many occurrences on
SIEVE_BITS = 18       # of the counters that pairs are sieved by before they are counted
SHARD = ("part long, shard long, local_start long, n_ids long, base long, rules binary, rule_lengths binary, "
         "symbols binary, doc_ids array<long>, doc_lengths array<long>")
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
DECODED = "part long, doc_id long, local_start long, n_tokens long, ids binary"


@dataclass
class Grammar:
    base: int
    rules: np.ndarray    # (n, 2) uint32
    lengths: np.ndarray  # expansion length of each rule
    symbols: np.ndarray


def _without_overlaps(seq: np.ndarray, at: np.ndarray, which: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences that are replaced: a run of one symbol is paired from its start."""
    if same.any():
        p = at[same]
        new_run = np.concatenate(([True], (np.diff(p) != 1) | (np.diff(seq[p]) != 0)))
        first = np.maximum.accumulate(np.where(new_run, np.arange(len(p)), 0))
        drop = np.zeros(len(at), bool)
        drop[np.flatnonzero(same)[(np.arange(len(p)) - first) % 2 == 1]] = True
        at, which = at[~drop], which[~drop]
    return at, which


def compress(ids: np.ndarray, base: int) -> Grammar:
    """Re-Pair over one shard; terminals are below ``base``."""
    seq = ids.astype(np.int64)
    rules: list[np.ndarray] = []
    size = base
    least = MIN_COUNT
    while len(seq) > 1:
        # pairs fall into counters; only those of a counter that reaches the least count can be frequent
        codes = seq[:-1] * size + seq[1:]
        slot = (codes.view(np.uint64) * _SPREAD >> np.uint64(64 - SIEVE_BITS)).view(np.int64)
        at = np.flatnonzero((np.bincount(slot, minlength=1 << SIEVE_BITS) >= least)[slot])
        codes, pair, counts = np.unique(codes[at], return_inverse=True, return_counts=True)
        frequent = np.flatnonzero(counts >= least)
        if not len(frequent):
            break
        frequent = frequent[np.lexsort((codes[frequent], -counts[frequent]))]
        # most frequent first; a symbol is only a left or only a right part in a round
        lefts, rights, alone, picked = set(), set(), set(), []
        for c, a, b in zip(frequent.tolist(), (codes[frequent] // size).tolist(), (codes[frequent] % size).tolist()):
            if a == b:
                if a in lefts or a in rights or a in alone:
                    continue
                alone.add(a)
            else:
                if a in rights or b in lefts or a in alone or b in alone:
                    continue
                lefts.add(a)
                rights.add(b)
            picked.append(c)
        chosen = np.full(len(codes), -1)
        chosen[picked] = np.arange(len(picked))
        which = chosen[pair]
        at, which = at[which >= 0], which[which >= 0]
        pairs = np.stack([codes[picked] // size, codes[picked] % size], 1)
        at, which = _without_overlaps(seq, at, which, (pairs[:, 0] == pairs[:, 1])[which])
        used, symbol = np.unique(which, return_inverse=True)
        rules.append(pairs[used])
        seq[at] = size + symbol
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        size += len(used)
    table_ = np.concatenate(rules).astype(np.uint32) if rules else np.zeros((0, 2), np.uint32)
    lengths = np.ones(base + len(table_), np.int64)
    done = 0
    for r in rules:  # rules of a round only refer to earlier rounds
        lengths[base + done:base + done + len(r)] = lengths[r[:, 0]] + lengths[r[:, 1]]
        done += len(r)
    return Grammar(base, table_, lengths[base:].astype(np.uint32), seq.astype(np.uint32))


def _expansions(g: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """All rules written out one after the other, and where each begins."""
    starts = np.concatenate(([0], np.cumsum(g.lengths.astype(np.int64))))
    flat = np.zeros(int(starts[-1]), np.uint32)
    base, begin, end = g.base, starts[:-1].tolist(), starts[1:].tolist()
    for i, (a, b) in enumerate(g.rules.tolist()):
        p = begin[i]
        for x in (a, b):
            if x < base:
                flat[p] = x
                p += 1
            else:
                n = end[x - base] - begin[x - base]
                flat[p:p + n] = flat[begin[x - base]:end[x - base]]
                p += n
    return flat, starts


def expand(g: Grammar, symbols: np.ndarray | None = None) -> np.ndarray:
    """Ids of a symbol sequence (the whole shard by default)."""
    symbols = (g.symbols if symbols is None else symbols).astype(np.int64)
    flat, starts = _expansions(g)
    flat = np.concatenate([flat, np.arange(g.base, dtype=np.uint32)])
    rule = symbols >= g.base
    at = np.where(rule, 0, len(flat) - g.base + symbols)
    at[rule] = starts[symbols[rule] - g.base]
    lens = np.ones(len(symbols), np.int64)
    lens[rule] = g.lengths[symbols[rule] - g.base]
    return ragged_take(flat, at, lens)


def decode_range(g: Grammar, start: int, length: int) -> np.ndarray:
    """Random access: ids ``[start, start + length)`` of a shard, expanding
    only the symbols that cover them."""
    lens = np.ones(len(g.symbols), np.int64)
    rule = g.symbols >= g.base
    lens[rule] = g.lengths[g.symbols[rule].astype(np.int64) - g.base]
    ends = np.cumsum(lens)
    if length <= 0 or start >= ends[-1]:
        return np.zeros(0, np.uint32)
    i = int(np.searchsorted(ends, start, "right"))
    j = int(np.searchsorted(ends, start + length, "left"))
    out: list[int] = []
    stack = g.symbols[i:j + 1][::-1].tolist()
    while stack:
        x = stack.pop()
        if x < g.base:
            out.append(x)
        else:
            a, b = g.rules[x - g.base].tolist()
            stack += [b, a]
    skip = start - (int(ends[i]) - int(lens[i]))
    return np.array(out[skip:skip + length], np.uint32)


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, "<u4").tobytes()


def _ints(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u4")


def _grammar(row: dict) -> Grammar:
    return Grammar(row["base"], _ints(row["rules"]).reshape(-1, 2), _ints(row["rule_lengths"]), _ints(row["symbols"]))


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def write_shards(docs: DataFrame, tokenizer: str | None = None, spaced: bool = False, end_id: int = END_ID,
                 shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode, compress and write all documents; returns the written table."""
    path = tokenizer or default_tokenizer()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc = encoder(path, spaced)
        base = enc.tokenizer.get_vocab_size()
        part = TaskContext.get().partitionId()
        state = {"shard": 0, "start": 0}
        ids, names, lens, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal held
            g = compress(np.concatenate(ids), base)
            row = {"part": part, "shard": state["shard"], "local_start": state["start"], "n_ids": held, "base": base,
                   "rules": _bytes(g.rules), "rule_lengths": _bytes(g.lengths), "symbols": _bytes(g.symbols),
                   "doc_ids": list(names), "doc_lengths": list(lens)}
            state["shard"] += 1
            state["start"] += held
            ids.clear(), names.clear(), lens.clear()
            held = 0
            return pa.RecordBatch.from_pylist([row], schema=_SHARD_ARROW)

        for batch, texts in text_slices(batches):
            flat, counts = with_end(*enc.encode(texts), end_id)
            doc_ids = column(batch, "doc_id").to_pylist()
            at = 0
            for d, n in zip(doc_ids, counts.tolist()):
                ids.append(flat[at:at + n])
                names.append(d)
                lens.append(n)
                at += n
                held += n
                if held >= shard_ids:
                    yield close()
        if held:
            yield close()

    # rows of one id may be many: they are ranged by their texts' hashes too
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("hash", F.md5(F.coalesce("text", F.lit(""))))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return stored(ordered.mapInArrow(shards, SHARD), "id-shards")


_SHARD_ARROW = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("local_start", pa.int64()), ("n_ids", pa.int64()),
                          ("base", pa.int64()), ("rules", pa.binary()), ("rule_lengths", pa.binary()),
                          ("symbols", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64()))])


def _per_document(shards: DataFrame, fields: list, payload) -> DataFrame:
    """One row per document of the shards, global start first."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = expand(_grammar(row))
                lens = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(lens)
                starts = ends - lens
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(lens), pa.int64()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(row["local_start"] + starts, pa.int64()), pa.array(lens, pa.int64()),
                     pa.array([payload(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist())], fields[0])],
                    ["part", "doc_id", "local_start", "n_tokens", fields[1]])

    # partition totals: one row per range partition of the writer
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    out = shards.mapInArrow(read, f"part long, doc_id long, local_start long, n_tokens long, {fields[1]} {fields[2]}")
    return (out.join(F.broadcast(before), "part")
               .select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", fields[1]))


def read_ids(shards: DataFrame) -> DataFrame:
    """Documents read back: ``doc_id, start, n_tokens, ids`` (binary, little-endian unsigned 32-bit)."""
    return _per_document(shards, [pa.binary(), "ids", "binary"], _bytes)


def read_checksums(shards: DataFrame) -> DataFrame:
    """Documents read back, their ids reduced to a crc32."""
    return _per_document(shards, [pa.int64(), "ids_crc32", "long"], lambda x: zlib.crc32(_bytes(x)))


def op1_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_checksums(write_shards(table(spark, sf_dir, "documents")))


QUERIES = {"op1_repair_ids": op1_repair_ids}
