"""Sequence packing by non-negative least squares over length patterns (operator 8).

Every document is cut at multiples of the window; what is left (its *tail*,
shorter than the window) is packed by a plan:

1. the histogram of tail lengths, at most ``window - 1`` numbers whatever the
   input, comes to the driver;
2. shallow patterns that fill a window exactly are enumerated: all pairs of
   lengths, and triples over the lengths where the pairs leave a surplus;
3. non-negative least squares finds how often to use each pattern;
4. counts are rounded down and trimmed to the histogram;
5. tails the rounded plan doesn't take are packed greedily, in length order, one
   after the other into windows, cut where a window ends; the last, unfinished
   window is divided at powers of two, which need no padding.

So only the pieces of step 5 cross a cut, and no sequence is padded at all.
Which pattern instance takes a tail follows from the tail's rank among equal
lengths: rank within its task's rows (counted in one pass) plus the counts of
the tasks before.  The plan and the histogram are bounded by the window, so
they are broadcast; ids move once, in a join on (task, length), which no hot
length can flood.

Ids are stored once (little-endian unsigned 16- or 32-bit) before planning, so
planning and placing see the same rows.  Null texts count as empty (one end
id); repeated rows are separate documents; null ids are kept; an empty table
gives no piece; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.llm.common import column, stored, table, text_slices
from spanweave.llm.encoding import encoder, with_end

WINDOW = 1024
END_ID = 0
TRIPLE_LENGTHS = 48  # triples are drawn from this many surplus lengths
ROUNDS = 400         # of the projected gradient
ROWS = 1000          # documents whose pieces are made at once
ENCODED = "part long, doc_id long, n_tokens long, tail int, tail_rank long, full_before long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, spaced: bool = True,
           end_id: int = END_ID) -> DataFrame:
    """Ids of every whole text plus the end id, written once; each row also has
    the rank of its tail among equal tails of its task and the full windows of
    its task before it."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seen, full = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        enc = encoder(path, spaced)
        for batch, texts in text_slices(batches):
            flat, counts = with_end(*enc.encode(texts), end_id)
            ends = np.cumsum(counts)
            tails = counts % window
            ranks = np.zeros(len(tails), np.int64)
            for i, t in enumerate(tails.tolist()):
                ranks[i] = seen[t]
                seen[t] += 1
            fulls = counts // window
            before = full + np.cumsum(fulls) - fulls
            full += int(fulls.sum())
            raw = flat.astype("<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(counts), part), pa.int64()), column(batch, "doc_id").cast(pa.int64()),
                 pa.array(counts, pa.int64()), pa.array(tails, pa.int32()), pa.array(ranks, pa.int64()),
                 pa.array(before, pa.int64()),
                 pa.array([raw[e - n:e].tobytes() for e, n in zip(ends.tolist(), counts.tolist())], pa.binary())],
                ["part", "doc_id", "n_tokens", "tail", "tail_rank", "full_before", "ids"])

    return stored(docs.select("doc_id", "text").mapInArrow(run, ENCODED), "packing-ids")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """min |A x - b| with x >= 0, by accelerated projected gradient."""
    gram, target = a.T @ a, a.T @ b
    step = 1.0 / max(np.linalg.norm(gram, np.inf), 1e-12)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (gram @ y - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def patterns(histogram: np.ndarray, triple_lengths: int = TRIPLE_LENGTHS) -> list[tuple[int, ...]]:
    """Length combinations that fill the window: pairs, then triples over the
    lengths with the largest surplus after pairing (a length and its
    complement cancel)."""
    window = len(histogram)
    have = histogram > 0
    out: list[tuple[int, ...]] = [(a, window - a) for a in range(1, window // 2 + 1) if have[a] and have[window - a]]
    surplus = histogram[1:] - histogram[1:][::-1]
    order = np.argsort(-surplus, kind="stable")[:triple_lengths] + 1
    pool = sorted(int(x) for x in order if surplus[x - 1] > 0)
    for i, a in enumerate(pool):
        for b in pool[i:]:
            c = window - a - b
            if c >= b and have[c]:
                out.append((a, b, c))
    return out


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, within the histogram."""
    found = patterns(histogram)
    if not found:
        return []
    a = np.zeros((len(histogram), len(found)))
    for j, p in enumerate(found):
        for length in p:
            a[length, j] += 1
    scale = max(1.0, float(histogram.max()))
    x = nnls(a, histogram / scale) * scale
    left, out = histogram.astype(np.int64).copy(), []
    order = np.argsort(-x, kind="stable")
    uses = np.zeros(len(found), np.int64)
    for _ in range(2):  # rounded down; then what is still possible, most used first
        for j in order.tolist():
            need = np.bincount(found[j], minlength=len(histogram))
            room = int(min(left[k] // need[k] for k in set(found[j])))
            n = room if _ else min(int(x[j] + 1e-9), room)
            if n > 0:
                left -= n * need
                uses[j] += n
    out = [(found[j], int(uses[j])) for j in order.tolist() if uses[j]]
    return out


def _plan_tables(spark: SparkSession, histogram: np.ndarray, n_full: int) -> tuple[DataFrame, np.ndarray, dict]:
    """Slots of the plan by tail length, and the greedy stream's layout."""
    used, next_seq = np.zeros(len(histogram), np.int64), n_full
    slots = []
    for pattern, n in plan(histogram):
        offset = 0
        for length in pattern:
            slots.append((length, int(used[length]), int(used[length]) + n, next_seq, offset))
            used[length] += n
            offset += length
        next_seq += n
    rest = histogram - used
    volume = rest * np.arange(len(histogram))
    base = np.cumsum(volume) - volume
    total = int(volume.sum())
    stream = {"used": used.tolist(), "base": base.tolist(), "total": total, "sequence": next_seq}
    df = spark.createDataFrame(slots or [], "tail int, from_rank long, to_rank long, first_sequence long, slot_offset int")
    return df, rest, stream


def greedy_bounds(total: int, window: int) -> list[int]:
    """Ends of the last unfinished window's power-of-two sequences."""
    at, left, ends = total - total % window, total % window, []
    while left:
        size = 1 << (left.bit_length() - 1)
        at += size
        left -= size
        ends.append(at)
    return ends


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, spaced: bool = True,
         end_id: int = END_ID) -> DataFrame:
    """Pieces with their ids: ``doc_id, start, length, doc_tokens,
    sequence_id, offset, ids`` (little-endian unsigned 32-bit integers)."""
    spark = docs.sparkSession
    rows = encode(docs, window, tokenizer, spaced, end_id)
    by_part = rows.groupBy("part", "tail").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("n_tokens") / window)).alias("full"))
    by_part = stored(by_part, "packing-counts")
    histogram, n_full = np.zeros(window, np.int64), 0
    for r in by_part.groupBy("tail").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect():  # <= window rows
        histogram[r.tail] = r.n if r.tail else 0
        n_full += r.full
    slots, _, stream = _plan_tables(spark, histogram, n_full)
    used, base, total, first = stream["used"], stream["base"], stream["total"], stream["sequence"]
    last = greedy_bounds(total, window)
    whole = total // window

    # ranks of equal tails and full windows, over the tasks before
    by_length = Window.partitionBy("tail").orderBy("part")
    before = by_part.select("part", "tail", (F.sum("n").over(by_length) - F.col("n")).alias("rank_before"))
    fulls = by_part.groupBy("part").agg(F.sum("full").alias("n"))
    fulls = fulls.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("full_offset"))  # one row per task
    offsets = before.join(fulls, "part")
    placed = rows.join(offsets, ["part", "tail"]).withColumn("rank", F.col("tail_rank") + F.col("rank_before"))
    s = F.broadcast(slots.withColumnRenamed("tail", "slot_tail"))
    placed = placed.join(s, (F.col("tail") == F.col("slot_tail")) & (F.col("rank") >= F.col("from_rank"))
                         & (F.col("rank") < F.col("to_rank")), "left")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            out = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
            names = ("doc_id", "n_tokens", "tail", "rank", "full_before", "full_offset", "from_rank", "first_sequence", "slot_offset", "ids")
            for doc, n, tail, rank, f0, f1, slot, seq, off, raw in zip(*(column(batch, x).to_pylist() for x in names)):
                cut = [(i * window, window, f0 + f1 + i, 0) for i in range(n // window)]
                at = n - tail
                if tail and slot is not None:
                    cut.append((at, tail, seq + rank - slot, off))
                elif tail:
                    p = base[tail] + (rank - used[tail]) * tail
                    stop = p + tail
                    while p < stop:
                        k = p // window
                        if k < whole:
                            begin, end, seq_id = k * window, (k + 1) * window, first + k
                        else:
                            j = next(i for i, e in enumerate(last) if p < e)
                            begin, end, seq_id = (last[j - 1] if j else whole * window), last[j], first + whole + j
                        size = min(stop, end) - p
                        cut.append((at, size, seq_id, p - begin))
                        at += size
                        p += size
                words = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                for start, size, seq_id, offset in cut:
                    for k, v in zip(out, (doc, start, size, n, seq_id, offset, words[start:start + size].tobytes())):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_PIECES_ARROW)

    return placed.select("doc_id", "n_tokens", "tail", "rank", "full_before", "full_offset", "from_rank", "first_sequence",
                         "slot_offset", "ids").mapInArrow(pieces, PIECES)


_PIECES_ARROW = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")]
                          + [("ids", pa.binary())])


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))


QUERIES = {"op8_nnls_packing": op8_nnls_packing}
